"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pandas as pd
import pytest

from scriptorium.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> Counter:
    def value(v):
        if v is None or not isinstance(v, list | tuple) and pd.isna(v):
            return None
        return str(v) if isinstance(v, str | bool) or type(v).__name__ == "bool_" else f"{float(v):.9g}"

    return Counter(tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, sql):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), sql.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 60
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
