"""Learning queues: sightings are counted, and what is seen often enough is promoted.

A queue is derived from its sightings instead of updated: counts and sets of sources are
aggregations, and promotion is a filter on them. Merging with an earlier state adds the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.fuzzy import heard_by_sound

PROMOTE_FROM = 3


def queue(sightings: DataFrame, key: Column) -> DataFrame:
    """key, occurrences, sources, first: over sightings (term, source, pos)."""
    return sightings.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("source")).alias("sources"), F.min_by("term", "pos").alias("term")
    )


def merged(state: DataFrame, new: DataFrame) -> DataFrame:
    """Two queues as one: counts added, sources joined, the earlier spelling kept."""
    both = state.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return both.groupBy("key").agg(
        F.sum("occurrences").alias("occurrences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.min_by("term", "age").alias("term")
    )


def promoted(pending: DataFrame, least: int = PROMOTE_FROM) -> DataFrame:
    """New entries, of tier C and boost 2, for what was seen often enough."""
    return pending.where(F.col("occurrences") >= least).select(
        F.concat(F.lit("discovered-"), F.regexp_replace("key", r"\s+", "-")).alias("id"), F.col("term").alias("canonical"), F.lit("C").alias("tier"), F.lit(2.0).alias("boost_weight"), "occurrences"
    )


def still_pending(pending: DataFrame, least: int = PROMOTE_FROM) -> DataFrame:
    return pending.where(F.col("occurrences") < least)


def heard(terms: DataFrame, originals: DataFrame) -> DataFrame:
    """Terms of which any word was really said (originals: word, in lower case)."""
    words = terms.select("term", F.explode(F.split(F.lower("term"), r"\s+")).alias("word"))
    said = words.join(originals.select("word").distinct(), "word", "left_semi").select("term").distinct()
    return terms.join(said, "term", "left_semi")


def alias_counts(sightings: DataFrame, least: int = PROMOTE_FROM) -> DataFrame:
    """entry_id, alias, n, promoted: how often an alias was heard for an entry."""
    counted = sightings.groupBy("entry_id", F.lower("alias").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("promoted", F.col("n") >= least)


def unusual(term: Column, common: tuple[str, ...]) -> Column:
    """Why a name is too ordinary to learn, or null: no word of four letters, or only common words."""
    parts = F.split(F.lower(F.trim(term)), r"\s+")
    return F.when(~F.exists(parts, lambda w: F.length(w) >= 4), "too_short").when(F.forall(parts, lambda w: w.isin(list(common))), "common_words")


def supported(term: Column, words: Column) -> Column:
    """exact if all words of a name were heard, partial if at least half of the distinct ones were."""
    own = F.array_distinct(F.split(F.lower(F.trim(term)), r"\s+"))
    shared = F.size(F.array_intersect(own, words))
    return F.when(shared == F.size(own), "exact").when(shared * 2 >= F.size(own), "partial")


def discover(entities: DataFrame, known: DataFrame, common: tuple[str, ...], min_confidence: float, least: int, by_sound: float | None = 0.6) -> DataFrame:
    """Adds outcome to entities (text, confidence, count, words): the first gate that stops each. Without the gate of
    sound, ``heard`` (whether the words support the name) may stand for words.

    known: form, in lower case. Counts are of all sightings, before equal names were joined; each name
    stands once. A name that was not heard as it is spelt may still sound like a word that was, with the
    confidence ``by_sound``; with None that gate is left out.
    """
    low = entities.where(F.col("confidence") >= min_confidence).withColumn("form", F.lower(F.trim("text")))
    found = low.join(known.select("form").distinct().withColumn("is_known", F.lit(True)), "form", "left")
    plain = unusual(F.col("text"), common).isNotNull() | (F.col("count") < least)
    missed = ~F.col("heard") if "heard" in entities.columns else supported(F.col("text"), F.col("words")).isNull()
    unheard = ~plain & F.col("is_known").isNull() & missed
    sounds = F.lit(False)
    if by_sound is not None:
        heard_as = heard_by_sound(found.where(unheard).select("form", "words"), by_sound).withColumnRenamed("word", "heard_as")
        found = found.join(heard_as, "form", "left")
        sounds = F.col("heard_as").isNotNull()
    return found.withColumn(
        "outcome",
        F.when(plain, "rejected_weirdness").when(F.col("is_known"), "already_in_dictionary").when(unheard & ~sounds, "rejected_hallucinations").otherwise("discovered"),
    ).drop("is_known")
