"""Inputs that every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, bucket string, `key` string, score string"
WORDS = [f"w{i}" for i in range(400)]


def row(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, "clash", 7, "clash", "clash", "clash")


BASE = " ".join(WORDS[:60]) + "."
ODD_ROWS = [
    row(1, None),
    row(2, ""),
    row(3, " \n\t "),
    row(4, "one two"),
    row(5, "one two"),
    row(5, "one two"),
    row(None, "one two"),
    row(None, None, None),
    row(6, BASE, None),
    row(7, BASE.upper(), "b"),
    row(8, BASE.replace("w30", "changed"), "b"),
    row(9, " ".join(WORDS) * 60, "c"),
    row(10, "\u00e9t\u00e9 \U0001f600 \u4e2d\u6587 x" * 3, "c"),
    row(11, "Mail a.b@c.example.org or +1 (293) 555-9179, card 4111 1111 1111 1111, ip 10.0.0.255.", "c"),
    row(12, "same line\nsame line\nHome | About | Contact\nAll rights reserved.\n" + BASE, "b"),
    row(13, "x" * 50_000, "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def copies(spark):
    """A third of the rows share one text, another third are near copies of one text."""
    near = lambda i: " ".join("edit" if j == i % 50 + 5 else w for j, w in enumerate(WORDS[100:220]))
    rows = [row(i, BASE) for i in range(60)] + [row(100 + i, near(i), "b") for i in range(60)] + [row(200 + i, " ".join(f"u{i}x{j}" for j in range(40)), "c") for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("text", F.col("text")).cache()
