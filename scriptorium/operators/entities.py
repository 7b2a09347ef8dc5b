"""Recognized entities as rows (text, entity_type, confidence): cleaning and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import stripped


def accepted(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """Entities with a confidence between ``least`` and 1 and with a text and a type, stripped, the surest
    first; scores that are missing, no number or out of range are left out."""
    clean = entities.withColumn("text", stripped(F.col("text"))).withColumn("entity_type", stripped(F.col("entity_type")))
    score = F.col("confidence")
    valid = score.between(0.0, 1.0) & ~F.isnan(score) & (score >= least)
    return clean.where(valid & (F.col("text") != "") & (F.col("entity_type") != "")).orderBy(score.desc(), "text")


def of_types(entities: DataFrame, types: list[str]) -> DataFrame:
    """Entities of some types, in any case; no types, no entities."""
    wanted = sorted({t.strip().lower() for t in types if t and t.strip()})
    return entities.where(F.lower(stripped(F.col("entity_type"))).isin(wanted) if wanted else F.lit(False))


def safe_name(value: Column) -> Column:
    """Whether an id or canonical has 1 to 200 characters and no path in it."""
    return F.coalesce(F.length(value).between(1, 200) & ~value.rlike(r"\.\.|[/\\]"), F.lit(False))


def derived(runs: DataFrame) -> DataFrame:
    """Runs (duration, transcription_time, correction_time, wer_raw, wer_corrected) with their real-time
    factor, total time, improvement and accuracies; what a missing rate would give is missing."""
    accuracy = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), 1 - F.col(c)))
    return (
        runs.withColumn("rtf", F.when(F.col("duration") > 0, F.col("transcription_time") / F.col("duration")).otherwise(0.0))
        .withColumn("total_time", F.col("transcription_time") + F.col("correction_time"))
        .withColumn("wer_improvement", F.col("wer_raw") - F.col("wer_corrected"))
        .withColumn("accuracy_raw", accuracy("wer_raw"))
        .withColumn("accuracy_corrected", accuracy("wer_corrected"))
    )


def scored_errors(rows: DataFrame) -> DataFrame:
    """Error rates (n_ref, substitutions, deletions, wer) with the words that are correct and the accuracy,
    which is never negative."""
    correct = F.col("n_ref") - F.col("substitutions") - F.col("deletions")
    return rows.withColumn("correct", correct).withColumn("accuracy", F.greatest(F.lit(0.0), 1 - F.col("wer")))
