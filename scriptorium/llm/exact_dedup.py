"""Exact dedup by content-defined chunk recipes.

A rolling hash over ``WINDOW`` bytes cuts each text where its low bits are zero, so equal passages
give equal chunks wherever they stand. A text becomes its recipe: the ordered fingerprints of its
chunks. Fingerprints that stand in one place only need no check. For the others the chunks' bytes
are compared: distinct (fingerprint, bytes) pairs are formed on the map side and then by a shuffle,
and where one fingerprint turns out to name different bytes, an ordinal tells them apart. Recipes
with these verified identifiers are equal if and only if the texts are, so the texts themselves are
never shuffled: only recipes, and one copy of each repeated chunk from each task.

Groups are counted by partial aggregation, so thousands of copies meet as a few partial rows. The
join of rows with the groups of more than one text has both sides as plain exchanges, which
adaptive execution broadcasts or splits where they are small or skewed.

Defined results: null counts as empty, and all empty texts are equal. Of equal texts the row with
the largest doc_id stays (a null doc_id is the smallest); of rows equal in text and doc_id exactly
one stays. Very long texts have long recipes and are compared to their end. An empty table gives an empty
result. Other columns never take part, and the stage that
drops rows returns them as they came.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels
from scriptorium.llm.shared import bitmap_of, durable, keep_rows, unpack

WINDOW = 32
CHUNK_BITS = 10
MAX_CHUNK = 16_384
#: Bytes of repeated chunks that a task remembers, to send each once.
SEEN_BYTES = 32 << 20


def cuts(block: kernels.Block, bits: int = CHUNK_BITS) -> Iterator[tuple[int, list[int]]]:
    """For each text of a block, the ends of its chunks."""
    n = len(block.data)
    marks = np.zeros(0, np.int64)
    if n > WINDOW:
        prefixes = kernels.prefix_hashes(block)
        at = np.arange(n - WINDOW + 1)
        rolled = kernels.range_hashes(prefixes, at, at + WINDOW)
        marks = np.flatnonzero((rolled & np.uint64((1 << bits) - 1)) == 0) + WINDOW
    bounds = np.searchsorted(marks, block.offsets).tolist()
    marks, offsets = marks.tolist(), block.offsets.tolist()
    for i in range(block.n):
        start, stop, ends = offsets[i], offsets[i + 1], []
        for end in (*(m for m in marks[bounds[i] : bounds[i + 1]] if m - start >= WINDOW), stop):
            while end - start > MAX_CHUNK:
                start += MAX_CHUNK
                ends.append(start)
            if end > start:
                ends.append(end)
                start = end
        yield i, ends


def fingerprint(data: bytes, bits: int) -> int:
    """The low bits of a 64-bit hash, as a signed long."""
    low = xxhash.xxh3_64_intdigest(data) & ((1 << bits) - 1)
    return low - (1 << 64) if low >> 63 else low


def _chunks(block: kernels.Block, bits: int) -> Iterator[tuple[int, bytes, list[tuple[int, bytes]]]]:
    """For each text: its row, its bytes, and its chunks with their fingerprints."""
    raw = block.data.tobytes()
    offsets = block.offsets.tolist()
    for i, ends in cuts(block):
        starts = [offsets[i], *ends[:-1]]
        parts = [raw[a:b] for a, b in zip(starts, ends, strict=False)]
        yield block.first + i, raw[offsets[i] : offsets[i + 1]], [(fingerprint(p, bits), p) for p in parts]


def recipes(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """__uid, __key, __sha, __recipe for each row; the number of a row is fixed once it is written."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in kernels.blocks(batch.column(1)):
                found = [(hashlib.sha256(data).hexdigest(), [f for f, _ in parts]) for _, data, parts in _chunks(block, bits)]
                columns = [
                    pa.array(range(uid, uid + block.n), pa.int64()),
                    batch.column(0).slice(block.first, block.n),
                    pa.array([s for s, _ in found], pa.string()),
                    pa.array([r for _, r in found], pa.list_(pa.int64())),
                ]
                uid += block.n
                yield pa.RecordBatch.from_arrays(columns, names=["__uid", "__key", "__sha", "__recipe"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(made, f"__uid long, __key {kind}, __sha string, __recipe array<long>")


def _bytes_of(docs: DataFrame, text: str, bitmap: bytes, bits: int) -> DataFrame:
    """__f and __bytes of the chunks that the bitmap lets through, each once from a task at most
    (as long as the task remembers it)."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen, held = unpack(bitmap), {}, 0
        mask = len(wanted) - 1
        for batch in batches:
            for block in kernels.blocks(batch.column(0)):
                out: list[tuple[int, bytes]] = []
                for _, _, parts in _chunks(block, bits):
                    for f, part in parts:
                        if wanted[f & mask] and seen.get(f) != part:
                            out.append((f, part))
                            if f not in seen:
                                seen[f] = part
                                held += len(part)
                if held > SEEN_BYTES:
                    seen, held = {}, 0
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], names=["__f", "__bytes"])

    return docs.select(text).mapInArrow(sent, "__f long, __bytes binary")


def _places_of(docs: DataFrame, text: str, bitmap: bytes, bits: int) -> DataFrame:
    """__uid, __at, __f, __bytes of every chunk that the bitmap lets through."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = unpack(bitmap)
        mask = len(wanted) - 1
        for batch in batches:
            for block in kernels.blocks(batch.column(0)):
                rows = [(sha, at, f, part) for _, data, parts in _chunks(block, bits) for sha in [hashlib.sha256(data).hexdigest()] for at, (f, part) in enumerate(parts) if wanted[f & mask]]
                kinds = (("__sha", pa.string()), ("__at", pa.int32()), ("__f", pa.int64()), ("__bytes", pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return docs.select(text).mapInArrow(sent, "__sha string, __at int, __f long, __bytes binary")


def verified(docs: DataFrame, made: DataFrame, text: str, bits: int) -> DataFrame:
    """Adds __variants to the recipes: ordinals of the chunks whose fingerprint names several."""
    repeated = made.select(F.explode("__recipe").alias("__f")).groupBy("__f").count().where("count > 1").select("__f")
    repeated = durable(repeated)
    contents = _bytes_of(docs, text, bitmap_of(repeated, "__f"), bits).join(repeated, "__f", "left_semi").distinct()
    shared = durable(contents.groupBy("__f").count().where("count > 1").select("__f"))
    none = F.array().cast("array<string>")
    if shared.isEmpty():
        return made.withColumn("__variants", none)
    places = _places_of(docs, text, bitmap_of(shared, "__f"), bits).join(shared, "__f", "left_semi")
    # the bytes themselves are the ordinal; only chunks of clashing fingerprints come here
    named = places.distinct().groupBy("__sha").agg(F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("__at").cast("string"), 10, "0"), F.hex("__bytes")))).alias("__variants"))
    return durable(made.join(named, "__sha", "left").withColumn("__variants", F.coalesce("__variants", none)))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 for each row. ``bits`` shortens fingerprints in tests."""
    made = durable(recipes(docs, key, text, bits))
    listed = verified(docs, made, text, bits)
    same = ["__recipe", "__variants"]
    groups = listed.groupBy(*same).agg(F.count(F.lit(1)).alias("__n"), F.max(F.struct(F.col("__key").alias("key"), F.col("__uid").alias("uid"))).alias("__best"))
    groups = durable(groups.where("__n > 1"))
    joined = listed.join(groups, same, "left")
    single = F.col("__n").isNull()
    return joined.select(
        F.col("__key").alias(key),
        F.when(single, F.col("__key")).otherwise(F.col("__best.key")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("__best.uid") == F.col("__uid"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    judged = exact_dedup(docs, key, text)
    best: Column = F.col(key).eqNullSafe(F.col("keep_id"))
    keepers = judged.where(best).groupBy(F.col(key).alias("__key"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__twins"))
    return keep_rows(docs, durable(keepers), key, text)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
