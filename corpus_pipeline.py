"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is
written as Parquet to the shared folder and read again as the next stage's documents, so a lost
executor costs at most a stage; what a stage read is deleted when its own result is there. All but the
last return the columns of documents.

Stages keep or drop whole rows by their operators' decisions, and the operators' rules for nulls,
ties, repeated rows and empty tables hold here as well. Quality rules pass texts on without the lines
they remove. Near duplicates leave the document with the smallest id. The mix repeats a document as
often as it is taken, the last time cut to the words taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from scriptorium.llm.queries import tokenizer
from scriptorium.llm.shared import documents, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, with their clean texts."""
    return quality_rules.clean_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts."""
    return ngram_join.distinct_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, and the token ids of each document of the mix."""
    return bpe.encode_documents(docs, *tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Merges by rank have no SQL; a test compares every stage with a plain version.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is the last one's."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _drop(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
