"""Compaction keeps the rows, statistics reach the planner, exports are written in order."""

from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import order
from scriptorium.operators import render as N
from scriptorium.sources import maintenance as M


def test_small_files_become_few(spark, tmp_path):
    rows = spark.range(3_000).withColumn("word", F.concat(F.lit("w"), F.col("id") % 7))
    rows.repartition(40).write.parquet(str(tmp_path / "many"))
    sizes = {r.path: r.bytes for r in M.file_sizes(spark, str(tmp_path / "many")).collect()}
    target = sum(sizes.values()) // 4
    M.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), target)
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "few")).collect())) == Counter(map(tuple, rows.collect()))
    assert len(sizes) == 40 and len(list((tmp_path / "few").glob("*.parquet"))) <= 6


@pytest.mark.parametrize("groups", [10_000, 5])
def test_bins_are_never_overfull(spark, groups):
    files = [(f"f{i}", (i * 37) % 90 + 1) for i in range(60)] + [("huge", 500), ("none", 0)]
    bins = {r.path: r.bin for r in M.packed_files(spark.createDataFrame(files, "path string, bytes long"), 100, groups).collect()}
    held = Counter()
    for path, size in files:
        held[bins[path]] += size
    assert set(bins) == {p for p, _ in files} and all(n <= 100 or n == 500 for n in held.values())
    assert groups == 5 or len(held) <= 1 + sum(s for _, s in files if s < 500) // 60


def test_the_planner_reads_the_statistics(spark, tmp_path):
    spark.range(1_234).selectExpr("id", "id % 5 as k", "array(id) as a").write.parquet(str(tmp_path / "t"))
    try:
        known = M.analyze(spark, "analyzed_rows", str(tmp_path / "t"))
        assert "rowCount=1.23E+3" in known._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
        described = {r.info_name: r.info_value for r in spark.sql("DESCRIBE EXTENDED analyzed_rows k").collect()}
        assert (described["min"], described["max"], described["distinct_count"]) == ("0", "4", "5")
        found = {r.column: tuple(r)[1:] for r in M.column_statistics(known).collect()}
        assert found == {"id": (1234, 0, 1234, "0", "1233"), "k": (1234, 0, 5, "0", "4")}
    finally:
        spark.sql("DROP TABLE IF EXISTS analyzed_rows")
        spark.conf.unset("spark.sql.cbo.enabled")


def test_numbers_count_through_all_parts(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 7919 % 1_000).alias("k"), F.col("id").alias("v")).repartition(9)
    found = [(r.k, r.n) for r in order.numbered(rows, [F.col("k"), F.col("v")], str(tmp_path / "n"), "n").collect()]
    assert sorted(n for _, n in found) == list(range(1, 501)) and [k for k, _ in sorted(found, key=lambda x: x[1])] == sorted(k for k, _ in found)
    assert order.numbered(rows.limit(0), [F.col("k")], str(tmp_path / "none")).count() == 0


def test_an_export_is_written_in_order(spark, tmp_path):
    schema = "id long, canonical string, display string, type string, tier string, boost_weight double, aliases array<struct<alias:string>>, contexts array<string>, pronunciations array<struct<ipa:string>>, notes string"
    rows = [(1, "b", "", "org", "B", 1.0, [("x",)], ["T"], [("",), ("/b/",)], None), (2, "A", "Aa", "org", "B", 0.5, None, None, None, "n"), (3, "é", None, "misc", "A", 1.0, [], [], [], ""), (4, "z", None, "misc", "H", 1.0, [], ["t"], [], "")]
    N.write_export(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "e"), "now")
    lines = [json.loads(line) for f in sorted(Path(tmp_path / "e" / "entries").glob("part-*")) for line in f.read_text().splitlines()]
    assert [e["canonical"] for e in lines] == ["é", "A", "b", "z"]
    assert lines[2] == {"canonical": "b", "type": "org", "tier": "B", "boost_weight": 1.0, "aliases": ["x"], "pronunciations": ["/b/"], "contexts": ["T"]}
    assert lines[1]["display"] == "Aa" and lines[1]["notes"] == "n" and lines[1]["aliases"] == []
    (envelope,) = (json.loads(f.read_text()) for f in Path(tmp_path / "e" / "envelope").glob("part-*") if f.stat().st_size)
    assert envelope["count"] == 4 and envelope["exported_at"] == "now"
    nested = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in N.kept_for_export(nested, "B", "t").collect()) == [1] and N.kept_for_export(nested, "Q").count() == 4


def test_every_customer_becomes_an_entry(spark, tmp_path):
    """Parts have numbers that customers get, and customers' names repeat."""
    import duckdb

    from scriptorium.plans import catalog

    con = duckdb.connect()
    tables = {t: f"SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'" for t in ("customer", "part", "lineitem", "supplier", "nation", "region")}
    tables["customer"] += " UNION ALL SELECT * REPLACE (c_custkey + 10000 AS c_custkey) FROM customer"
    tables["part"] = f"SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM ({tables['part']})"
    tables["lineitem"] = f"SELECT * REPLACE (l_partkey + 1000000 AS l_partkey) FROM ({tables['lineitem']})"
    con.execute("CREATE VIEW customer AS " + tables["customer"].split(" UNION")[0])
    for t, made in tables.items():
        con.execute(f"COPY ({made}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(f"SELECT kind, id, value FROM ({catalog.ORACLES['create_entries']})").fetchall()
    assert Counter(map(tuple, catalog.QUERIES["create_entries"](spark, str(tmp_path)).select("kind", "id", "value").collect())) == Counter(want)


def test_values_are_gathered_by_many_tasks(spark):
    """Rows of one file are dealt out before their values are gathered."""
    rows = spark.createDataFrame([(i % 5 or None, float(i % 3), [i]) for i in range(60)], "k long, x double, a array<int>").coalesce(1)
    found = M.column_statistics(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("RepartitionByExpression")
    assert sorted(map(tuple, found.collect())) == [("k", 60, 12, 4, "1", "4"), ("x", 60, 0, 3, "0.0", "2.0")]
