"""Embedding whitening by TSQR: the R factor of the centred rows, and its right singular vectors.

An entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. Whitening needs the unit
eigenvectors of the x-vectors' covariance, which are the right singular vectors of the centred rows; the
covariance itself, whose squares would cost half of the digits, is never formed.

1. Sums. Tasks add up rows and dimensions in whole numbers, so the means are exact. Only sums leave them.
2. QR. Row i is (n * x - S) / n, whose numerator is exact. A task goes through its rows in blocks: the R
   of those before and the block are factored together, so it holds one block and one triangle.
3. Tree. The triangles are dealt into groups of ``fan_in`` and factored again, until one is left; each
   round is a shuffle of triangles, d * d numbers each, never of rows.
4. SVD of the last triangle, which the driver does: d * d numbers, whatever the input. Singular values
   give eigenvalues s * s / n, right vectors the components; each vector's largest entry is positive.
5. Whitening is a projection by map-side tasks, with d * k numbers broadcast. Their covariance is
   measured before the rows are returned: sums of k * k products over all rows.

Lost executors cost their tasks: no step keeps anything outside shuffle files and checkpoints.

Defined results: a row is left out if its vector is null or holds a null, a non-finite entry, or one
beyond 2^40, which no x could hold exactly; and if its length is not the table's commonest one (of
equally common lengths the greatest), as it has no place among the others. Repeated rows count as often
as they stand; null ids are ordinary ids. A component without variance (all rows equal, more dimensions
than rows) has null as its whitened value, an explained share of 0, and no part in ``identity_error``;
explained is null where nothing varies at all. ``deviation`` is null where the exact sum is greater than
a long, ``deviation_exact`` holds it as a decimal string in any case. Components with equal eigenvalues may
be any basis of their space. An empty table gives an empty result; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels
from scriptorium.llm.shared import durable

STEP, SHIFT = 1_024, 100_000
COMPONENTS = 8
#: Entries are below this, so that x and its sums are exact.
GREATEST = float(1 << 40)
#: Numbers in a block of rows, and in the triangles that one task merges.
BLOCK_NUMBERS = 1 << 20
MERGED_NUMBERS = 1 << 22


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """__key and __v, an array of doubles, of the rows whose vector has finite entries only."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < GREATEST))
    return vectors.select(F.col(key).alias("__key"), v.alias("__v")).where(v.isNotNull() & sound)


def dimension(rows: DataFrame) -> int:
    """The commonest length of the vectors, the greatest of those; 0 if there are none."""
    found = rows.groupBy(F.size("__v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return found.d if found else 0


def whole(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The x-vectors of a batch, in blocks of rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    rows = max(1, BLOCK_NUMBERS // d)
    for at in range(0, len(flat), rows):
        yield np.floor(flat[at : at + rows] * STEP).astype(np.int64) + SHIFT


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sums of their x by dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for x in whole(batch.column(0), d):
                n += len(x)
                # in two parts, neither of which can leave 64 bits
                high += (x >> 26).sum(axis=0)
                low += (x & ((1 << 26) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.concatenate([[0], high])), pa.array(np.concatenate([[n], low]))], names=["i", "high", "low"])

    wide = "decimal(38,0)"
    made = rows.select("__v").mapInArrow(kernels.trimmed(added), "i long, high long, low long") if d else None
    if made is None:
        return 0, []
    total = made.groupBy("i").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    found = {r.i: (int(r.high) << 26) + int(r.low) for r in total.toLocalIterator()}  # d + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in whole numbers: of Python's where 64 bits might not hold them."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def factors(rows: DataFrame, d: int, n: int, sums: list[int]) -> DataFrame:
    """r: the triangle of each task that has rows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for x in whole(batch.column(0), d):
                r = np.linalg.qr(np.concatenate([r, centred(x, n, sums).astype(float) / n]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return rows.select("__v").mapInArrow(kernels.trimmed(made), "r binary")


def merged_factor(triangles: DataFrame, d: int, fan_in: int) -> np.ndarray:
    """The triangle of all rows, by a tree of merges."""

    def joined(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x.as_buffer(), float).reshape(-1, d) for x in table["r"]])
        r = np.linalg.qr(r, mode="r")
        kernels.give_back()
        return pa.table([pa.array([r.tobytes()], pa.binary())], names=["r"])

    held = durable(triangles)
    while (count := held.count()) > 1:
        groups = -(-count // fan_in)
        dealt = held.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        held = durable(dealt.groupBy("g").applyInArrow(joined, "r binary"))
    one = held.first()
    return np.frombuffer(bytes(one.r), float).reshape(-1, d) if one else np.zeros((0, d))


class Whitening(NamedTuple):
    """What has been fitted: rows, sums by dimension, components by falling eigenvalue (rows of a matrix),
    their eigenvalues, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows n * x - S; not a number where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return (y.astype(float) / self.n) @ self.components.T * scale


def fit(rows: DataFrame, d: int, most: int = COMPONENTS, fan_in: int | None = None) -> Whitening:
    """Components of usable rows of one length."""
    n, sums = exact_sums(rows, d)
    if not n:
        return Whitening(0, sums, np.zeros((0, d)), np.zeros(0), 0.0)
    fan_in = fan_in or max(2, min(64, MERGED_NUMBERS // (d * d)))
    r = merged_factor(factors(rows, d, n, sums), d, fan_in)
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(d - len(s))])
    # what rounding leaves of a dimension without variance is no variance
    s[s <= s.max(initial=0) * 8 * d * np.finfo(float).eps] = 0
    k = min(most, d)
    vt = vt[:k]
    vt = vt * np.where(vt[np.arange(k), np.abs(vt).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, sums, vt, s[:k] ** 2 / n, float((s**2).sum() / n))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, measured over all rows. Their
    means are 0, as the sums of n * x - S are."""
    d, live = len(model.sums), model.eigenvalues > 0
    k = int(live.sum())
    if not k:
        return 0.0

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for x in whole(batch.column(0), d):
                w = model.project(centred(x, model.n, model.sums))[:, live]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "s"])

    sums = rows.select("__v").mapInArrow(kernels.trimmed(added), "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    covariance = np.zeros(k * k)
    for r in sums.toLocalIterator():  # k * k rows
        covariance[r.i] = r.s / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def deviations(y: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS, fan_in: int | None = None) -> DataFrame:
    """key, component, n, deviation, deviation_exact, whitened, explained and identity_error for each usable
    row and component."""
    rows = usable(vectors, key, vector)
    d = dimension(rows)
    rows = rows.where(F.size("__v") == d)
    model = fit(rows, d, most, fan_in)
    error = identity_error(rows, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.eigenvalues)
    explained = [float(e / model.trace) if model.trace else None for e in model.eigenvalues]
    names = [key, "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches if k else ():
            at = 0
            for x in whole(batch.column(1), d):
                y = centred(x, fitted.n, fitted.sums)
                m, sums = len(x), deviations(y)
                of = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    batch.column(0).slice(at, m).take(of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n)),
                    pa.array([s if s < 1 << 63 else None for s in sums], pa.int64()).take(of),
                    pa.array(list(map(str, sums)), pa.string()).take(of),
                    pa.array(fitted.project(y).ravel(), from_pandas=True),  # not a number becomes null
                    pa.array(explained * m, pa.float64()),
                    pa.array(np.full(m * k, error)),
                ]
                at += m
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = vectors.schema[key].dataType.simpleString()
    return rows.mapInArrow(kernels.trimmed(made), f"`{key}` {kind}, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double")
