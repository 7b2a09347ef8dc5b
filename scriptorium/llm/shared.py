"""What several operators share: durable intermediate results, let-bindings, word splitting."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, and tab to carriage return.
GAPS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a local session, as in tests, may name none and gets a temporary one: on a cluster the machines
    do not share theirs, so a lost executor could not be recovered from.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    return named or tempfile.mkdtemp("-checkpoints")


def durable(df: DataFrame) -> DataFrame:
    """Write a result to the shared checkpoint folder and go on from there.

    Later stages then neither recompute the result nor depend on the executor that made it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that nothing refers to any more.

    Its cleaner works when the driver's garbage is collected, which a driver with little to do seldom
    is; between the large stages of one operator the disk would hold the files of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times in one expression, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs of other characters than white space, in order; null has none.

    White space becomes spaces by plain replacement, and the split is at one plain character: both
    work on bytes, where patterns and translate() go through every character.
    """
    spaced = F.coalesce(text, F.lit(""))
    for gap in GAPS[1:]:
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A bitmap has 8 bits or more for each value, up to 2^27 in all (16 MB).
BITMAP_BITS = (16, 27)


def bitmap_of(values: DataFrame, column: str) -> bytes:
    """A bit for each residue of the values of a long column, 2^k bits as the number of values asks for.

    A value whose bit is not set is certainly not there. Bits are set by segment on the executors, so
    the driver gets 16 MB at most; beyond 2^27 / 8 values the map lets more and more through, and the
    exact join that follows it always decides.
    """
    import numpy as np
    import pyarrow as pa

    least, most = BITMAP_BITS
    bits = min(most, max(least, (8 * values.count()).bit_length()))
    width = 1 << 16

    def packed(table: pa.Table) -> pa.Table:
        held = np.zeros(width, bool)
        held[table["r"].to_numpy() & (width - 1)] = True
        return pa.table([[table["g"][0].as_py()], pa.array([np.packbits(held).tobytes()], pa.binary())], names=["g", "b"])

    residues = values.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("r")).distinct()
    found = residues.withColumn("g", F.shiftright("r", 16)).groupBy("g").applyInArrow(packed, "g long, b binary").toArrow()
    made = bytearray(1 << (bits - 3))
    for g, b in zip(found["g"].to_pylist(), found["b"].to_pylist(), strict=True):
        made[g * width // 8 : (g + 1) * width // 8] = b
    return bytes(made)


def unpack(bitmap: bytes):
    """The bitmap as an array of booleans."""
    import numpy as np

    return np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)


def keep_rows(docs: DataFrame, keepers: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs whose key and text digest stand in keepers (__key, __sha, __twins).

    Of rows equal in both, of which __twins tells the number, one stays. All columns are kept.
    """
    columns = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"),
        F.col(key).alias("__key"),
        F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("__sha"),
    )
    wanted = keepers.select(F.col("__key").alias("__k"), F.col("__sha").alias("__s"), "__twins")
    kept = rows.join(wanted, (F.col("__sha") == F.col("__s")) & F.col("__key").eqNullSafe(F.col("__k")))
    if not keepers.where("__twins > 1").isEmpty():
        twins = kept.where("__twins > 1").dropDuplicates(["__key", "__sha"])
        kept = kept.where("__twins = 1").unionByName(twins)
    return kept.select(*[F.col("__row")[c].alias(c) for c in columns])
