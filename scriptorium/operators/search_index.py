"""Searches of many queries at once, by stored postings of letter groups.

The index holds the distinct lower-case forms of canonicals and aliases, and for each group of one, two or three
letters the forms that it stands in. A query asks for its rarest group of three letters (of two or one, if
it is shorter), so it meets the shortest posting that can answer it, by an equality join; what it meets is then
checked for the whole query. No query goes through all forms, and common groups are never asked for unless
a query consists of nothing else; such postings are plain join partitions, which adaptive execution splits.

Defined results: queries are taken in lower case without white space at their ends; empty and null ones find
nothing, wildcards mean themselves. Equal queries are answered once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import stripped
from scriptorium.operators.ranking import tier_weight

GROUP = 3
#: Scores of equal, leading and other hits, for canonicals and for aliases.
SCORES = ((1.0, 0.9, 0.7), (0.95, 0.85, 0.65))


class SearchIndex(NamedTuple):
    """forms: form, branch (0 for canonicals, 1 for aliases), id, matched. postings: gram, form. grams: gram, n."""

    forms: DataFrame
    postings: DataFrame
    grams: DataFrame

    def save(self, folder: str) -> None:
        """Postings sorted by group, so that a reader skips what it does not ask for."""
        self.forms.write.parquet(f"{folder}/forms")
        self.postings.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/postings")
        self.grams.write.parquet(f"{folder}/grams")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SearchIndex:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in cls._fields))


def _groups(text: Column, size: int) -> Column:
    """The distinct groups of so many letters; none for a shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def build(entries: DataFrame, aliases: DataFrame) -> SearchIndex:
    own = entries.select(F.lower("canonical").alias("form"), F.lit(0).alias("branch"), "id", F.col("canonical").alias("matched"))
    other = aliases.select(F.lower("alias").alias("form"), F.lit(1).alias("branch"), F.col("entry_id").alias("id"), F.col("alias").alias("matched"))
    forms = own.unionByName(other).where("form != ''")
    every = F.flatten(F.array(*[_groups(F.col("form"), n) for n in range(1, GROUP + 1)]))
    postings = forms.select("form").distinct().select(F.explode(every).alias("gram"), "form")
    return SearchIndex(forms, postings, postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))


def met_forms(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """query, q, form: the forms that hold a query."""
    q = queries.select("query", stripped(F.lower("query")).alias("q")).where("q != ''").distinct()
    size = F.least(F.length("q"), F.lit(GROUP))
    groups = F.when(size == 1, _groups(F.col("q"), 1)).when(size == 2, _groups(F.col("q"), 2)).otherwise(_groups(F.col("q"), GROUP))
    asked = q.select("query", "q", F.explode(groups).alias("gram")).join(index.grams, "gram", "left")
    rarest = asked.groupBy("query", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    met = rarest.select("query", "q", F.col("r.gram").alias("gram")).join(index.postings, "gram")
    return met.where(F.contains("form", "q")).select("query", "q", "form")


def search_many(entries: DataFrame, index: SearchIndex, queries: DataFrame, limit: int = 20, language: str = "en", kind: str | None = None, tier: str | None = None) -> DataFrame:
    """query, place, id, canonical, score, matched_on: what a ranked search finds for each query.

    As for a single query, canonicals and aliases are each cut to the limit before they meet, and an entry
    stands once, by its canonical if that was found.
    """
    if limit < 1:
        raise ValueError("a limit of 1 or more is needed")
    kept = entries.where(F.col("language") == language)
    kept = kept.where(F.col("type") == kind) if kind else kept
    kept = kept.where(F.col("tier") == tier) if tier else kept
    kept = kept.select("id", "canonical", "tier", "boost_weight", "occurrence_count")
    hits = met_forms(index, queries).join(index.forms, "form").join(kept, "id")
    hits = hits.withColumn("rank", F.when(F.col("form") == F.col("q"), 0).when(F.startswith("form", "q"), 1).otherwise(2))
    used = F.when(F.col("branch") == 0, -F.col("occurrence_count")).otherwise(F.lit(0))
    cut = Window.partitionBy("query", "branch").orderBy("rank", "tier", used, "id", "matched")
    few = hits.withColumn("n", F.row_number().over(cut)).where(F.col("n") <= limit)
    first = Window.partitionBy("query", "id").orderBy("branch", "rank", "matched")
    best = few.withColumn("n", F.row_number().over(first)).where("n = 1")
    match = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in SCORES])[F.col("branch")], F.col("rank") + 1)
    scored = best.withColumn("score", match * tier_weight(F.col("tier"), 0.5) * F.col("boost_weight"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "branch", "rank", "tier", "id")
    done = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return done.select("query", "place", "id", "canonical", "score", F.when(F.col("branch") == 0, "canonical").otherwise("alias").alias("matched_on"))
