"""Readers of the file formats the engine takes: dictionaries, vocabularies, transcripts, session logs."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import infer_type
from scriptorium.operators.ranking import Profile

PRONUNCIATION = T.StructType([T.StructField("ipa", T.StringType()), T.StructField("phoneme_sequence", T.StringType())])
ENTRY = T.StructType(
    [
        T.StructField("canonical", T.StringType()),
        T.StructField("display", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("boost_weight", T.DoubleType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField("pronunciations", T.ArrayType(PRONUNCIATION)),
        T.StructField("notes", T.StringType()),
    ]
)
WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("confidence", T.DoubleType())])
SEGMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("words", T.ArrayType(WORD)),
    ]
)
TRANSCRIPT = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("audio_path", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("segments", T.ArrayType(SEGMENT)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
#: Names that no vocabulary may have.
RESERVED = frozenset((".", "..", "pending_vocabulary", "config"))


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON files that hold a list, or an object with a list under ``entries``."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.from_json("value", T.ArrayType(ENTRY))
    nested = F.from_json("value", T.StructType([T.StructField("entries", T.ArrayType(ENTRY))]))["entries"]
    rows = text.select(F.explode(F.when(F.col("value").startswith("["), listed).otherwise(nested)).alias("e")).select("e.*")
    return rows.where(F.trim("canonical") != "")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """term, domain and type of text files with one term a line; blank lines and comments are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("term"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("domain"))
    kept = rows.where((F.col("term") != "") & ~F.col("term").startswith("#"))
    return kept.withColumn("type", infer_type(F.col("term"), F.col("domain")))


def domains(spark: SparkSession, path: str) -> DataFrame:
    return vocabulary(spark, path).select("domain").distinct().orderBy("domain")


def valid_domain(name: str) -> bool:
    return 0 < len(name) <= 64 and all(c.isalnum() or c in "_-" for c in name) and name not in RESERVED


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """transcript (file name) and its header; broken files keep their text in _corrupt_record."""
    read = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.withColumn("transcript", F.col("_metadata.file_name"))


def transcript_segments(rows: DataFrame) -> DataFrame:
    """One row for each segment; a blank speaker counts as none, and segments that end before they start go."""
    each = rows.where("_corrupt_record is null").select("transcript", F.inline("segments"))
    return each.withColumn("speaker", F.nullif(F.trim("speaker"), F.lit(""))).where("end >= start and start >= 0")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """session (file name) and line of session logs."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("session"), F.col("value").alias("line"))


def profile(text: str) -> Profile | None:
    """A context profile from its JSON, or None if it is not one; fields that are not known are ignored."""
    try:
        raw = json.loads(text)
        made = Profile(raw["name"], tuple(raw.get("include_tiers") or ()), tuple(raw.get("include_contexts") or ()), int(raw.get("max_entries", 150)), float(raw.get("boost_multiplier", 1.0)), raw.get("description", ""))
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return made if made.max_entries >= 1 and 0 <= made.boost_multiplier <= 10 else None


def profiles(folder: str) -> list[str]:
    """Names of the profiles in a configuration folder."""
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path and the first sixteen hex digits of each file's SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", F.left(F.sha2("content", 256), F.lit(16)).alias("digest"))


def filter_chain(*filters: str | None) -> str:
    """Names of filters joined by commas, those not wanted left out."""
    return ",".join(f for f in filters if f)
