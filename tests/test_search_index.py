"""Batch searches by postings find what single searches find, query by query."""

from __future__ import annotations

import random

import pytest

from scriptorium.operators import ranking as R
from scriptorium.operators import search_index as I

QUERIES = ["a", " An ", "ann", "anna", "nna b", "%", "_", "x%", "é", "ßx", "", "  ", "zzz", "BOB", "bob", "bo", "b b", "anna bob carl dora"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    names = ["Anna", "Bob", "Carl", "Dora", "x%y", "Éva", "aßx", "ann", "_"]
    entries = [(i, " ".join(rng.choices(names, k=rng.randint(1, 3))), rng.choice(["person", "org"]), rng.choice("ABDH"), rng.choice([0.5, 1.0, 2.0]), rng.choice(["en", "en", "de"]), rng.randrange(4)) for i in range(90)]
    aliases = [(i, " ".join(rng.choices(names, k=rng.randint(1, 2)))) for i in range(90) for _ in range(rng.randrange(3))]
    return (
        spark.createDataFrame(entries, "id long, canonical string, type string, tier string, boost_weight double, language string, occurrence_count long").cache(),
        spark.createDataFrame(sorted(set(aliases)), "entry_id long, alias string").cache(),
    )


@pytest.mark.parametrize("limit, how", [(20, {}), (3, {}), (5, {"kind": "org", "tier": "A"}), (4, {"language": "de"})])
def test_each_query_as_if_alone(spark, rows, limit, how, tmp_path):
    entries, aliases = rows
    I.build(entries, aliases).save(str(tmp_path / "index"))
    index = I.SearchIndex.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(q,) for q in [*QUERIES, "bob", None]], "query string")
    got = {}
    for r in I.search_many(entries, index, asked, limit, **how).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.id, round(r.score, 9), r.matched_on))
    for q in QUERIES:
        want = [(r.id, round(r.score, 9), r.matched_on) for r in R.search_ranked(entries, aliases, q, limit, how.get("language", "en"), how.get("kind"), how.get("tier")).collect()]
        assert got.get(q, []) == want, q
    assert len(got) > 8


def test_no_query_goes_through_all_forms(spark, rows):
    entries, aliases = rows
    found = I.search_many(entries, I.build(entries, aliases), spark.createDataFrame([("ann",)], "query string"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_inputs(spark, rows):
    entries, aliases = rows
    index = I.build(entries.limit(0), aliases.limit(0))
    assert I.search_many(entries, index, spark.createDataFrame([("ann",)], "query string")).count() == 0
    assert I.search_many(entries, I.build(entries, aliases), spark.createDataFrame([], "query string")).count() == 0
    with pytest.raises(ValueError, match="limit"):
        I.search_many(entries, index, entries, 0)
