"""Upkeep of stored tables: many small files become few, and statistics that the planner reads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.order import spread

#: Files that one task packs.
GROUP_FILES = 10_000


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes of the files of a folder, none of which is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))


def packed_files(sizes: DataFrame, target: int, group_files: int = GROUP_FILES) -> DataFrame:
    """path, bin: files put into bins of ``target`` bytes at most, the largest first, each into the first bin that has
    room; a file of that size or more has a bin of its own. Files are packed in groups by a hash of their path."""
    groups = max(1, -(-sizes.count() // group_files))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("path", "ascending")])
        room: list[int] = []
        bins = []
        for size in table["bytes"].to_pylist():
            at = next((i for i, left in enumerate(room) if left >= size), len(room))
            if at == len(room):
                room.append(target)
            room[at] -= size
            bins.append(f"{table['g'][0].as_py()}-{at}")
        return pa.table([table["path"], pa.array(bins, pa.string())], names=["path", "bin"])

    dealt = sizes.withColumn("g", F.pmod(F.xxhash64("path"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(packed, "path string, bin string")


def compact(spark: SparkSession, folder: str, into: str, target: int = 128 << 20) -> None:
    """Write a table's rows to another folder in files of about ``target`` bytes of the old ones."""
    bins = packed_files(file_sizes(spark, folder), target)
    n = max(1, bins.select("bin").distinct().count())
    # paths are written differently by the two readers, so the files' own names are compared after the scheme
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    placed = rows.withColumn("__path", plain(F.col("_metadata.file_path"))).join(bins.select(plain(F.col("path")).alias("__path"), F.col("bin").alias("__bin")), "__path")
    placed.repartition(n, "__bin").drop("__path", "__bin").write.parquet(into)


def analyze(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Make a stored table known under a name and compute its statistics; the table with them. The planner is told to
    go by statistics in this session."""
    spark.conf.set("spark.sql.cbo.enabled", "true")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` USING parquet LOCATION '{folder}'")
    known = spark.table(name)
    columns = ", ".join(f"`{c}`" for c in _plain(known))
    spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS" + (f" FOR COLUMNS {columns}" if columns else ""))
    return spark.table(name)


def _plain(rows: DataFrame) -> list[str]:
    """The columns that have an order."""
    return [f.name for f in rows.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]


def column_statistics(rows: DataFrame) -> DataFrame:
    """column, n, n_null, n_distinct, least, greatest (as text) of the columns that have an order, by one pass.

    Rows are dealt to many tasks first: values are gathered where rows are read, and a small file is one task's.
    """
    plain = _plain(rows)
    if plain:
        rows = spread(rows.select(*plain), *plain)
    count = F.count(F.lit(1))
    made = [F.struct(F.lit(c).alias("column"), count.alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(F.col(c)).alias("n_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in plain]
    return rows.agg(F.array(*made).alias("s")).select(F.inline("s"))
