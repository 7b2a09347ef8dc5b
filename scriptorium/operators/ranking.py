"""Ranking of dictionary entries: scores, bias lists, profiles, context detection, searches.

Entries come nested (aliases and contexts as arrays), so no ranking joins; each is a filter, a score
column and a top-k, which Spark runs as one pass with a bounded heap on every task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
RECENT_DAYS = 60
#: Weights of the tiers.
TIER_WEIGHTS = {"A": 1.0, "B": 0.7, "C": 0.7, "D": 0.7, "E": 0.4, "F": 0.4, "G": 0.4, "H": 0.4}


@dataclass(frozen=True)
class Profile:
    """What a named context includes, how many entries it may have, and its factor."""

    name: str
    include_tiers: tuple[str, ...] = ()
    include_contexts: tuple[str, ...] = ()
    max_entries: int = 150
    boost_multiplier: float = 1.0
    description: str = field(default="", compare=False)


def tier_weight(tier: Column, unknown: float) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in TIER_WEIGHTS.items() for x in pair])
    return F.coalesce(weights[tier], F.lit(unknown))


def has_context(contexts: Column, *wanted: str) -> Column:
    """Any of the names, in any case."""
    return F.exists(contexts, lambda c: F.lower(c).isin([w.lower() for w in wanted]))


def recency(last_seen_us: Column, now_us: int) -> Column:
    """1 if last seen within the last 60 whole days, else one half; the future counts as old."""
    days = F.floor((F.lit(now_us) - last_seen_us) / DAY_US)
    return F.when(last_seen_us.isNotNull() & days.between(0, RECENT_DAYS), 1.0).otherwise(0.5)


def bias_score(now_us: int, context: str | None = None) -> Column:
    """Tier weight times boost (0.01 at least), context factor and recency."""
    fits = F.when(has_context(F.col("contexts"), context), 1.5).otherwise(1.0) if context else F.lit(1.0)
    return tier_weight(F.col("tier"), 0.4) * F.greatest(F.col("boost_weight"), F.lit(0.01)) * fits * recency(F.col("last_seen_us"), now_us)


def select_bias_list(
    entries: DataFrame,
    now_us: int,
    context: str | None = None,
    min_tier: str = "H",
    include_contexts: tuple[str, ...] = (),
    exclude_contexts: tuple[str, ...] = (),
    k: int = 60,
) -> DataFrame:
    """Top k by score, then canonical. Tier A passes the tier and include filters, not the exclude one."""
    top = F.col("tier") == "A"
    kept = entries.where(top | (F.col("tier") <= min_tier))
    if include_contexts:
        kept = kept.where(top | has_context(F.col("contexts"), *include_contexts))
    if exclude_contexts:
        kept = kept.where(~has_context(F.col("contexts"), *exclude_contexts))
    scored = kept.withColumn("score", bias_score(now_us, context))
    return scored.orderBy(F.col("score").desc(), F.lower("canonical"), "id").limit(k)


def select_with_profile(entries: DataFrame, profile: Profile, now_us: int, min_tier: str = "H") -> DataFrame:
    """Top entries of a profile: its tiers (A always), its contexts, its factor on the score."""
    top = F.col("tier") == "A"
    kept = entries.where(top | (F.col("tier") <= min_tier))
    if profile.include_tiers:
        kept = kept.where(top | F.col("tier").isin(list(profile.include_tiers)))
    if profile.include_contexts:
        kept = kept.where(has_context(F.col("contexts"), *profile.include_contexts))
    scored = kept.withColumn("score", bias_score(now_us, profile.name if profile.include_contexts else None) * profile.boost_multiplier)
    return scored.orderBy(F.col("score").desc(), "tier", F.col("boost_weight").desc(), F.col("occurrence_count").desc(), "id").limit(profile.max_entries)


def search_ranked(entries: DataFrame, aliases: DataFrame, query: str, limit: int, language: str = "en", kind: str | None = None, tier: str | None = None) -> DataFrame:
    """Canonical hits, then alias hits of other entries; each branch is cut before they meet.

    Wildcards in the query mean themselves. An empty query finds nothing.
    """
    q = query.strip().lower()
    kept = entries.where(F.col("language") == language)
    kept = kept.where(F.col("type") == kind) if kind else kept
    kept = kept.where(F.col("tier") == tier) if tier else kept
    kept = kept.where(F.lit(bool(q)))

    def branch(rows: DataFrame, form: str, scores: tuple[float, float, float], place: int) -> DataFrame:
        low = F.lower(form)
        rank = F.when(low == q, 0).when(low.startswith(q), 1).otherwise(2)
        order = [F.col("rank"), F.col("tier"), *([F.col("occurrence_count").desc()] if place == 0 else []), F.col("id"), F.col(form)]
        hits = rows.where(low.contains(q)).withColumn("rank", rank).orderBy(*order).limit(limit)
        match = F.when(F.col("rank") == 0, scores[0]).when(F.col("rank") == 1, scores[1]).otherwise(scores[2])
        return hits.select("id", "canonical", (match * tier_weight(F.col("tier"), 0.5) * F.col("boost_weight")).alias("score"), F.lit(place).alias("branch"), "rank", "tier", F.col(form).alias("matched"))

    by_alias = kept.join(aliases.withColumnRenamed("entry_id", "id"), "id")
    both = branch(kept, "canonical", (1.0, 0.9, 0.7), 0).unionByName(branch(by_alias, "alias", (0.95, 0.85, 0.65), 1))
    first = Window.partitionBy("id").orderBy("branch", "rank", "matched")
    best = both.withColumn("n", F.row_number().over(first)).where("n = 1")
    return best.orderBy(F.col("score").desc(), "branch", "rank", "tier", "id").limit(limit).select("id", "canonical", "score", F.when(F.col("branch") == 0, "canonical").otherwise("alias").alias("matched_on"))


def search_scored(entries: DataFrame, query: str, limit: int) -> DataFrame:
    """Integer scores: canonical 100/80/60, alias 90/70/50, display 40; the first rule that holds."""
    q = query.strip().lower()
    low = F.lower("canonical")
    some = lambda test: F.exists("aliases", lambda a: test(F.lower(a["alias"])))
    score = (
        F.when(low == q, 100)
        .when(low.startswith(q), 80)
        .when(low.contains(q), 60)
        .when(some(lambda a: a == q), 90)
        .when(some(lambda a: a.startswith(q)), 70)
        .when(some(lambda a: a.contains(q)), 50)
        .when(F.lower("display").contains(q), 40)
    )
    return entries.withColumn("score", score).where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.lower("canonical"), "id").limit(limit)


def detect_context(texts: DataFrame, keywords: dict[str, tuple[str, ...]], text: str = "text", whole_word: bool = False) -> DataFrame:
    """Adds detected: the context whose keywords found in the text have most words in all.

    Keywords are found as substrings, or as whole words if wanted; the first context wins ties, and
    a text without any keyword has none. Keywords are configuration and become literals.
    """
    low = F.lower(text)
    if whole_word:
        low = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    key = (lambda k: f" {k.lower()} ") if whole_word else str.lower
    weight = {c: sum((F.when(low.contains(key(k)), len(k.split())).otherwise(0) for k in ks), F.lit(0)) for c, ks in keywords.items()}
    best = F.greatest(*weight.values(), F.lit(0))
    return texts.withColumn("detected", F.coalesce(*[F.when((best > 0) & (w == best), c) for c, w in weight.items()]))


def forms(entries: DataFrame) -> DataFrame:
    """id, form, ord: canonical, display, then aliases that are no misspellings; first by lower case."""
    listed = F.concat(
        F.array(F.col("canonical"), F.col("display")), F.transform(F.filter("aliases", lambda a: ~a["is_common_misspelling"]), lambda a: a["alias"])
    )
    rows = entries.select("id", F.posexplode(listed).alias("ord", "form")).where("form is not null and trim(form) != ''")
    first = Window.partitionBy("id", F.lower("form")).orderBy("ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def with_keywords(keywords: dict[str, tuple[str, ...]], context: str, more: list[str]) -> dict[str, tuple[str, ...]]:
    """Keywords by context with more of one context: lower case, stripped, each once; the given ones stay."""
    low = (k.lower().strip() for k in more)
    return keywords | {context: tuple(dict.fromkeys([*keywords.get(context, ()), *(k for k in low if k)]))}


def select(entries: DataFrame, now_us: int, **how) -> DataFrame:
    """The bias list under its earlier name."""
    return select_bias_list(entries, now_us, **how)
