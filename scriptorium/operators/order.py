"""Where rows go: neighbours in an order that may hold any number of rows, and costly rows dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one chunk differ in their last bits only.
CHUNK_BITS = 16


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to several tasks for each core, whatever their bytes: for work that costs far more than
    reading them, which adaptive execution would put into few tasks as long as the rows are small."""
    spark = rows.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)


def followers(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Adds next: the key that follows within the group, null for its last row.

    Keys are whole numbers. Rows are ordered in chunks of 65,536 keys each, and only the chunks' first keys by
    group, however large a group is. Rows with a null key are left out; null is a group like others.
    """
    chunk = rows.where(F.col(key).isNotNull()).withColumn("__chunk", F.shiftright(F.col(key).cast("long"), CHUNK_BITS))
    near = chunk.withColumn("__next", F.lead(key).over(Window.partitionBy(group, "__chunk").orderBy(key)))
    firsts = chunk.groupBy(F.col(group).alias("__g"), F.col("__chunk").alias("__c")).agg(F.min(key).alias("__first"))
    then = firsts.withColumn("__then", F.lead("__first").over(Window.partitionBy("__g").orderBy("__c"))).drop("__first")
    met = near.join(then, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__chunk") == F.col("__c")), "left")
    return met.select(*rows.columns, F.coalesce("__next", "__then").alias("next"))



def numbered(rows: DataFrame, keys: list[Column], folder: str, name: str = "place") -> DataFrame:
    """Adds a number from 1 in the order of some keys, which should tell all rows apart.

    Rows are dealt by ranges of the keys, sorted and numbered in their part, and written to the folder, so that
    the ranges, which Spark draws from a sample, are the same for all that follows. Each part's numbers begin
    after those of the parts before it; only the sizes of parts are ordered as a whole.
    """
    spark, bits = rows.sparkSession, 33
    at = F.monotonically_increasing_id()  # the part, and the place in it
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_.withColumn("__at", at).write.parquet(folder)
    written = spark.read.parquet(folder).withColumn("__part", F.shiftright("__at", bits))
    sizes = written.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = sizes.select(F.col("__part").alias("__p"), before.alias("__start"))
    met = written.join(starts, F.col("__part") == F.col("__p"))
    return met.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << bits) - 1)) + 1).select(*rows.columns, name)
