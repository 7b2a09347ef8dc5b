"""Moves between learning queues, vocabularies and the dictionary, and usage learnt from corrections.

A move is two relations: what leaves the queue in its new form, and what stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.learning import PROMOTE_FROM


def pending(queue: DataFrame) -> DataFrame:
    """All waiting terms with their key, the most frequent first."""
    return queue.orderBy(F.col("occurrences").desc(), "key")


def left(queue: DataFrame, gone: DataFrame, by: str = "term") -> DataFrame:
    """The queue without the terms that were approved or rejected."""
    return queue.join(gone.select(by).distinct(), by, "left_anti")


def approved_terms(queue: DataFrame, wanted: DataFrame, domain: str | None = None) -> DataFrame:
    """term, domain of the waiting terms that were wanted: the queue's domain, unless another is given."""
    kept = queue.join(wanted.select("term").distinct(), "term", "left_semi")
    return kept.select("term", (F.lit(domain) if domain else F.col("domain")).alias("domain"))


def approved_nouns(queue: DataFrame, wanted: DataFrame, context: str | None = None) -> DataFrame:
    """New entries of waiting nouns (key, text, type, context, sources), found by their text in any case."""
    kept = queue.join(wanted.select(F.lower("text").alias("key")).distinct(), "key", "left_semi")
    own = F.lit(context) if context else F.coalesce("context", F.lit("discovered"))
    return kept.select(
        F.concat(F.lit("approved-"), F.replace("key", F.lit(" "), F.lit("-"))).alias("id"),
        F.col("text").alias("canonical"),
        "type",
        F.lit("C").alias("tier"),
        F.lit(2.0).alias("boost_weight"),
        F.array(own).alias("contexts"),
        F.concat(F.lit("approved:"), F.col("sources")[0]).alias("source"),
    )


def form_owners(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """form (lower case), entry_id: canonicals, displays and aliases; of entries with one form the last."""
    own = entries.select(F.col("id").alias("entry_id"), F.explode(F.array("canonical", "display")).alias("form"))
    forms = own.unionByName(aliases.select("entry_id", F.col("alias").alias("form")))
    return forms.where("form != ''").groupBy(F.lower("form").alias("form")).agg(F.max("entry_id").alias("entry_id"))


def corrections_of_entries(changes: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Changes (original, corrected) whose correction is a form of an entry, with its entry_id."""
    return changes.withColumn("form", F.lower(F.trim("corrected"))).join(form_owners(entries, aliases), "form").drop("form")


def used_entries(matched: DataFrame) -> DataFrame:
    """entry_id, n: how often corrections used each entry."""
    return matched.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))


def misheard(matched: DataFrame, least: int = PROMOTE_FROM) -> DataFrame:
    """entry_id, alias, n, promoted: what was heard instead of the entry's form, and how often."""
    wrong = matched.where((F.trim("original") != "") & (F.lower(F.trim("original")) != F.lower(F.trim("corrected"))))
    return wrong.groupBy("entry_id", F.lower(F.trim("original")).alias("alias")).agg(F.count(F.lit(1)).alias("n")).withColumn("promoted", F.col("n") >= least)


def corrected_entities(changes: DataFrame, sanitize) -> DataFrame:
    """entity: distinct corrections with a capital letter, made harmless for a prompt, in order."""
    named = changes.where(F.col("corrected").rlike(r"\p{Lu}")).select(sanitize(F.col("corrected")).alias("entity"))
    return named.where("entity != ''").distinct().orderBy("entity")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order, the rest left out: a concatenation without repetitions."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")
