"""The dictionary as relations: lookups, statistics, imports, and changes as pure functions.

A change returns the new relation; nothing is updated in place. Uniqueness rules are anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("person", "org", "product", "event", "location", "jargon", "misc")
TIERS = tuple("ABCDEFGH")


def by_canonical(entries: DataFrame, canonical: str, language: str = "en") -> DataFrame:
    """Case-sensitive."""
    return entries.where((F.col("canonical") == canonical) & (F.col("language") == language))


def lookup(entries: DataFrame, aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key the entry found by id, else by canonical, else by alias, in any case."""
    low = keys.select("key", F.lower(F.trim("key")).alias("low"))
    ways = [
        entries.select(F.col("id").cast("string").alias("low"), "id", F.lit(0).alias("way")),
        entries.select(F.lower("canonical").alias("low"), "id", F.lit(1).alias("way")),
        aliases.select(F.lower("alias").alias("low"), F.col("entry_id").alias("id"), F.lit(2).alias("way")),
    ]
    forms = ways[0].unionByName(ways[1]).unionByName(ways[2])
    # few keys against many forms: the forms are filtered by a broadcast only if Spark finds it small
    best = forms.join(low, "low").groupBy("key").agg(F.min(F.struct("way", "id")).alias("b"))
    return best.select("key", F.col("b.id").alias("id"), F.element_at(F.array(F.lit("id"), F.lit("canonical"), F.lit("alias")), F.col("b.way") + 1).alias("found_by"))


def ordered(entries: DataFrame, *columns: Column, limit: int | None = None) -> DataFrame:
    done = entries.orderBy(*columns, "id")
    return done.limit(limit) if limit else done


def by_tier(entries: DataFrame, tier: str, language: str = "en", limit: int | None = None) -> DataFrame:
    kept = entries.where((F.col("tier") == tier) & (F.col("language") == language))
    return ordered(kept, F.col("boost_weight").desc(), F.col("occurrence_count").desc(), limit=limit)


def by_context(entries: DataFrame, contexts: DataFrame, context: str, min_tier: str = "H", limit: int | None = None) -> DataFrame:
    """Entries tagged with the context, case-sensitively, of the tier or a higher one."""
    tagged = contexts.where(F.col("context") == context).select(F.col("entry_id").alias("id"))
    kept = entries.where(F.col("tier") <= min_tier).join(tagged, "id", "left_semi")
    return ordered(kept, F.col("tier"), F.col("boost_weight").desc(), F.col("occurrence_count").desc(), limit=limit)


def recent(entries: DataFrame, now_us: int, days: int, limit: int) -> DataFrame:
    since = now_us - days * 86_400_000_000
    return ordered(entries.where(F.col("last_seen_us") >= since), F.col("last_seen_us").desc(), limit=limit)


def top_by_usage(entries: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """Most used of the first 2k in tier order; with exact, of all."""
    by_tiers = [F.col("tier"), F.col("boost_weight").desc(), F.col("occurrence_count").desc()]
    first = entries if exact else ordered(entries, *by_tiers, limit=2 * k)
    return first.orderBy(F.col("occurrence_count").desc(), *by_tiers, "id").limit(k)


def stats(entries: DataFrame, aliases: DataFrame, contexts: DataFrame, pronunciations: DataFrame | None = None, updated: str | None = None) -> DataFrame:
    """dimension, key, n: totals, and counts by tier, type and context; the newest value of the column ``updated``
    (microseconds), null without entries, under the key last_updated."""
    one = F.count(F.lit(1)).alias("n")
    sets = entries.groupingSets([[], ["tier"], ["type"]], "tier", "type").agg(one, F.grouping_id().alias("g"))
    named = sets.select(
        F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "tier").otherwise("type").alias("dimension"),
        F.when(F.col("g") == 3, "entries").when(F.col("g") == 1, F.col("tier")).otherwise(F.col("type")).alias("key"),
        "n",
    )
    total = lambda rows, name: rows.agg(one).select(F.lit("total").alias("dimension"), F.lit(name).alias("key"), "n")
    if pronunciations is not None:
        named = named.unionByName(total(pronunciations, "pronunciations"))
    if updated:
        named = named.unionByName(entries.agg(F.max(updated).alias("n")).select(F.lit("total").alias("dimension"), F.lit("last_updated").alias("key"), "n"))
    return named.unionByName(total(aliases, "aliases")).unionByName(contexts.groupBy(F.col("context").alias("key")).agg(one).select(F.lit("context").alias("dimension"), "key", "n"))


def validate(entries: DataFrame) -> DataFrame:
    """Adds problem: the first constraint a row breaks, or null."""
    return entries.withColumn(
        "problem",
        F.when(F.trim("canonical") == "", "canonical")
        .when(~F.col("type").isin(list(TYPES)), "type")
        .when(~F.col("tier").isin(list(TIERS)), "tier")
        .when(~F.col("boost_weight").between(0, 3), "boost_weight"),
    )


def clean_import(rows: DataFrame) -> DataFrame:
    """Rows of an import with defaults for what is missing or invalid: type misc, tier D, boost in 0..3."""
    return rows.where(F.trim("canonical") != "").select(
        F.trim("canonical").alias("canonical"),
        F.coalesce(F.nullif(F.trim("display"), F.lit("")), F.trim("canonical")).alias("display"),
        F.when(F.lower("type").isin(list(TYPES)), F.lower("type")).otherwise("misc").alias("type"),
        F.when(F.upper("tier").isin(list(TIERS)), F.upper("tier")).otherwise("D").alias("tier"),
        F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.coalesce("boost_weight", F.lit(1.0)))).alias("boost_weight"),
    )


def new_entries(rows: DataFrame, existing: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Rows whose canonical is not there yet; of rows with the same one the first by canonical stays."""
    key = (lambda c: F.lower(c)) if ignore_case else F.col
    fresh = rows.withColumn("__k", key("canonical")).join(existing.select(key("canonical").alias("__k")), "__k", "left_anti")
    first = Window.partitionBy("__k").orderBy("canonical")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__k", "__n")


def delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Entries without the ids in gone, and child rows without those parents."""
    keys = {name: "id" if name == "entries" else "entry_id" for name in tables}
    return {name: rows.join(gone.select(F.col("id").alias(keys[name])), keys[name], "left_anti") for name, rows in tables.items()}


def patched(entries: DataFrame, patch: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Entries with the patch's values where it has them (id and any of the columns)."""
    renamed = patch.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    done = entries.join(renamed, "id", "left")
    for c in columns:
        done = done.withColumn(c, F.coalesce(f"__{c}", c))
    return done.drop(*[f"__{c}" for c in columns])


def added_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (entry_id, alias) that no entry has yet in any case, the smallest entry first."""
    low = wanted.where(F.trim("alias") != "").withColumn("__k", F.lower(F.trim("alias")))
    fresh = low.join(aliases.select(F.lower("alias").alias("__k")), "__k", "left_anti")
    return fresh.groupBy("__k").agg(F.min(F.struct("entry_id", F.trim("alias").alias("alias"))).alias("b")).select("b.entry_id", "b.alias")


def orphans(children: DataFrame, entries: DataFrame) -> DataFrame:
    """Child rows whose entry is missing."""
    return children.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def present(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (id) with found: whether there is such an entry."""
    return keys.join(entries.select("id", F.lit(True).alias("found")).distinct(), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def version(applied: DataFrame) -> DataFrame:
    """version: the highest migration (version) that was applied, 0 for none."""
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def outdated(applied: DataFrame, current: int) -> DataFrame:
    """needed: whether a store is behind the current version."""
    return version(applied).select((F.col("version") < current).alias("needed"))


def created(tables: dict[str, DataFrame], rows: DataFrame, unique_names: bool = True) -> dict[str, DataFrame]:
    """Entries, aliases and contexts with those of new entries (nested rows) appended.

    An alias that says what the canonical says, in any case, and one that is there already, are left
    out; so is an entry whose id is there and, with ``unique_names``, one whose canonical is.
    """
    fresh = new_entries(rows, tables["entries"]) if unique_names else rows
    fresh = fresh.join(tables["entries"].select("id"), "id", "left_anti")
    named = fresh.select(F.col("id").alias("entry_id"), "canonical", F.explode("aliases").alias("a")).select("entry_id", "canonical", F.trim("a.alias").alias("alias"), F.col("a.is_common_misspelling").alias("is_common_misspelling"))
    named = named.where((F.col("alias") != "") & ~F.lower("alias").eqNullSafe(F.lower("canonical"))).drop("canonical").dropDuplicates(["entry_id", "alias"])
    known = tables["aliases"].select(F.lower("alias").alias("__k")).distinct()
    named = named.withColumn("__k", F.lower("alias")).join(known, "__k", "left_anti").drop("__k")
    placed = fresh.select(F.col("id").alias("entry_id"), F.explode("contexts").alias("context")).distinct()
    own = tables["entries"].columns
    return {
        "entries": tables["entries"].unionByName(fresh.select(*[c for c in own if c in fresh.columns]), allowMissingColumns=True),
        "aliases": tables["aliases"].unionByName(named),
        "contexts": tables["contexts"].unionByName(placed),
    }


def replaced(children: DataFrame, patch: DataFrame) -> DataFrame:
    """Child rows with those of the patched entries put in place of their old ones."""
    return children.join(patch.select("entry_id").distinct(), "entry_id", "left_anti").unionByName(patch)


def removed(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """The tables without the entries that the keys name by id, canonical or alias, in any case."""
    return delete(tables, lookup(tables["entries"], tables["aliases"], keys).select("id").distinct())
