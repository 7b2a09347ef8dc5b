"""Interval algebra: merging, padding, greedy merging, splitting, de-duplication, batching.

Where a decision depends on sums and maxima of what came before, it is a window. Where it depends on
earlier decisions, it is a fold over one group in order (a recording or a transcript, whose length
bounds it): inside the JVM, or in Arrow where each row gives one of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SILENCE = 0.5
PAD = 0.15
FLOOR_SECONDS = 10.0


def _islands(rows: DataFrame, starts_new: Column, keys: list[str], order: list) -> DataFrame:
    """start and end of each run of rows; a run begins where the column is true."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("island", F.sum(F.when(starts_new, 1).otherwise(0)).over(upto))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def merge_gaps(intervals: DataFrame, key: str = "grp", min_silence: float = MIN_SILENCE) -> DataFrame:
    """Neighbours less than min_silence apart become one (start after the previous end)."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = intervals.withColumn("__end", F.lag("end").over(w))
    new = F.col("__end").isNull() | (F.col("start") - F.col("__end") >= min_silence)
    return _islands(before, new, [key], ["start", "end"])


def pad_and_merge(intervals: DataFrame, key: str = "grp", pad: float = PAD, total: Column | None = None) -> DataFrame:
    """Intervals widened on both sides within [0, total], merged where they touch."""
    wide = intervals.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - pad))
    wide = wide.withColumn("end", F.least(F.col("end") + pad, total) if total is not None else F.col("end") + pad)
    reach = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    before = wide.withColumn("__end", reach)
    return _islands(before, F.col("__end").isNull() | (F.col("start") > F.col("__end")), [key], ["start", "end"])


def sessions(events: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """key, session, n, first, last: runs of events no more than gap apart."""
    w = Window.partitionBy(key).orderBy(at, "id")
    marked = events.withColumn("__new", F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1))
    numbered = marked.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def _sorted_groups(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))


_SPAN = "array<struct<start:double,end:double>>"


def merge_small(intervals: DataFrame, key: str = "grp", least: float = 20.0, cap: float = 60.0, soft: float = 15.0, max_gap: float = 2.0, floor: bool = True) -> DataFrame:
    """Greedy merging from the left, then runs under ten seconds join a neighbour.

    A neighbour joins if the gap is at most max_gap, the result at most cap, and either is short:
    the current under least or soft, the next under least or three seconds.
    """
    none = F.array().cast(_SPAN)

    def step(done: Column, x: Column) -> Column:
        cur = F.element_at(done, -1)
        length, following = cur["end"] - cur["start"], x["end"] - x["start"]
        small = (length < least) | (following < least) | (length < soft) | (following < 3.0)
        joins = (x["start"] - cur["end"] <= max_gap) & (x["end"] - cur["start"] <= cap) & small
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(cur["start"].alias("start"), x["end"].alias("end"))))
        return F.when(F.size(done) == 0, F.array(x)).when(joins, joined).otherwise(F.concat(done, F.array(x)))

    def floor_step(state: Column, x: Column) -> Column:
        """state: accepted intervals, and the start that waits for the next one."""
        start = F.coalesce(state["wait"], x["start"])
        own = F.struct(start.alias("start"), x["end"].alias("end"))
        done, short = state["done"], x["end"] - start < FLOOR_SECONDS
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        return F.struct(
            F.when(short & (F.size(done) > 0), longer).when(short & ~x["last"], done).otherwise(F.concat(done, F.array(own))).alias("done"),
            F.when(short & (F.size(done) == 0) & ~x["last"], start).otherwise(F.lit(None).cast("double")).alias("wait"),
        )

    grouped = _sorted_groups(intervals, key, "start", "end").withColumn("merged", F.aggregate("rows", none, step))
    if floor:
        marked = F.transform("merged", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), (i == F.size("merged") - 1).alias("last")))
        start = F.struct(none.alias("done"), F.lit(None).cast("double").alias("wait"))
        floored = F.aggregate(marked, start, floor_step, lambda s: s["done"])
        grouped = grouped.withColumn("merged", F.when(F.size("merged") >= 2, floored).otherwise(F.col("merged")))
    return grouped.select(key, F.posexplode("merged").alias("pos", "x")).select(key, "pos", "x.start", "x.end")


def _in_order(rows: DataFrame, key: str, order: list[str], fold: Callable[[list[dict]], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """What a fold makes of each group's rows in order; a group is one recording, gone through once."""
    kind = rows.schema[key].dataType.simpleString()

    def gone_through(table: pa.Table) -> pa.Table:
        found = fold(table.sort_by([(c, "ascending") for c in order]).to_pylist())
        made = [pa.array([r[i] for r in found], pa.int64() if kind_.endswith("long") else pa.int32()) for i, kind_ in enumerate(schema.split(", "))]
        return pa.table([pa.repeat(table[key][0], len(found)), *made], names=[key, *names])

    return rows.groupBy(key).applyInArrow(gone_through, f"`{key}` {kind}, {schema}")


def drop_overlapping(segments: DataFrame, key: str = "grp", share: float = 0.5) -> DataFrame:
    """key, segment, id: segments of which not more than the share lies before the end of the last one kept."""

    def fold(rows: list[dict]) -> list[tuple]:
        kept: list[tuple] = []
        upto = 0.0
        for r in rows:
            length = r["end"] - r["start"]
            if not kept or length <= 0 or max(0.0, upto - r["start"]) <= share * length:
                kept.append((len(kept), r["id"]))
                upto = r["end"]
        return kept

    rows = segments.select(key, F.col("start").cast("double"), F.col("id").cast("long"), F.col("end").cast("double"))
    return _in_order(rows, key, ["start", "id", "end"], fold, ["segment", "id"], "segment int, id long")


def duration_batches(segments: DataFrame, key: str = "transcript", most: float = 30.0, rows: int = 10, least: int = 3) -> DataFrame:
    """key, segment, batch: a batch closes before it is too long or full, but not under ``least`` rows."""

    def fold(found: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        batch, n, length = 0, 0, 0.0
        for r in found:
            own = r["end"] - r["start"]
            if n and (length + own > most or n >= rows) and n >= least:
                batch, n, length = batch + 1, 0, 0.0
            n, length = n + 1, length + own
            out.append((r["segment"], batch))
        return out

    each = segments.select(key, F.col("segment").cast("long"), F.col("start").cast("double"), F.col("end").cast("double"))
    return _in_order(each, key, ["segment", "start", "end"], fold, ["segment", "batch"], "segment long, batch int")


def split_long(intervals: DataFrame, difficulty: Column, easy: float = 60.0, hard: float = 30.0, overlap: float = 2.0, hard_from: float = 0.35) -> DataFrame:
    """Windows of at most the cap over each interval, each beginning overlap before the last one's end.

    Their number follows from the length, so they are a sequence and not a loop.
    """
    cap = F.when(difficulty > hard_from, hard).otherwise(easy)
    stride = F.greatest(F.lit(1.0), cap - F.least(F.lit(overlap), cap - 1))
    length = F.col("end") - F.col("start")
    n = F.when(length <= cap, 1).otherwise(F.ceil((length - cap) / stride) + 1).cast("int")
    wide = intervals.withColumn("__cap", cap).withColumn("__stride", stride).withColumn("__n", n).where(length > 0)
    each = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    start = F.col("start") + F.col("part") * F.col("__stride")
    return each.withColumn("part_start", start).withColumn("part_end", F.least(F.col("end"), start + F.col("__cap"))).drop("__cap", "__stride", "__n")


def difficulty_of(samples: Column, speech: Column | None = None) -> Column:
    """How far the loudness of samples lies from the usual one, up to 1.

    Where the probabilities of speech by frame are known (not null, not empty), half of what they lack on the
    average and half of their variance, within 0 and 1.
    """
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    power = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples)
    loudness = F.when(F.size(samples) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.sqrt(power) - 0.2) / 0.2))
    if speech is None:
        return loudness

    def blend(average: Column) -> Column:
        spread = mean(F.transform(speech, lambda x: (x - average) * (x - average)))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - average) * 0.5 + spread * 0.5))

    known = speech.isNotNull() & (F.size(speech) > 0)
    return F.when(known, F.element_at(F.transform(F.array(mean(speech)), blend), 1)).otherwise(loudness)


def speech_segments(found: DataFrame, recordings: DataFrame, key: str = "grp", min_silence: float = MIN_SILENCE, pad: float = PAD) -> DataFrame:
    """key, start, end: what was found (key, start, end) with short silences closed, widened within the recording
    (key, total) and merged again. A recording in which nothing was found is one segment."""
    merged = merge_gaps(found, key, min_silence).join(recordings.select(key, "total"), key)
    heard = pad_and_merge(merged.select(key, "start", "end", "total"), key, pad, F.col("total")).select(key, "start", "end")
    silent = recordings.join(found.select(key).distinct(), key, "left_anti")
    return heard.unionByName(silent.select(key, F.lit(0.0).alias("start"), F.col("total").cast("double").alias("end")))


def chunks(segments: DataFrame, key: str = "grp", cap: float = 60.0, overlap: float = 2.0, between: float = 0.25, hard: float = 30.0, hard_from: float = 0.35, rate: int = 16_000) -> DataFrame:
    """key, chunk, start, length, difficulty: what a recognizer is given of each recording, in order.

    segments: key, start, end, difficulty, and total, the recording's length. A segment begins ``between``
    seconds early unless that lies before the end of the chunk before it, less a tenth of a second, and ends as
    much later; the first has no early begin and the last no late end. Segments longer than the cap, which is
    lower for hard ones, are cut into windows that overlap. Times are cut to samples of ``rate``; what has no
    sample is left out.

    Whether a segment begins early depends on the chunk before it, so a recording is gone through in order, by
    one task in Arrow; windows of a long segment follow from its length. Segments without times, or of a null
    recording length, are left out.
    """
    if rate <= 0 or cap <= 0 or overlap >= cap:
        raise ValueError("a rate and a cap above 0 are needed, and an overlap below the cap")
    kind = segments.schema[key].dataType.simpleString()

    def gone_through(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("end", "ascending")])
        columns = [table[c].to_numpy() for c in ("start", "end", "difficulty", "total")]
        out: list[tuple[float, float, float]] = []
        upto = None
        for i, (begins, ends, difficulty, total) in enumerate(zip(*columns, strict=True)):
            last = int(total * rate)
            early = max(0.0, begins - between)
            if i and between > 0 and (upto is None or early >= upto - 0.1):
                begins = early
            if i < table.num_rows - 1 and between > 0:
                ends = min(total, ends + between)
            if ends - begins <= 0:
                continue
            most = min(cap, hard) if difficulty > hard_from else cap
            stride = max(1.0, most - min(overlap, most - 1.0))
            parts = 1 if ends - begins <= most else math.ceil((ends - begins - most) / stride) + 1
            for k in range(parts):
                start = begins + k * stride
                stop = min(start + most, ends)
                length = (min(int(stop * rate), last) - int(start * rate)) / rate
                if length <= 0:
                    break
                out.append((start, length, difficulty))
                upto = start + length
        made = [pa.repeat(table[key][0], len(out)), pa.array(range(len(out)), pa.int32()), *(pa.array([r[k] for r in out], pa.float64()) for k in range(3))]
        return pa.table(made, names=[key, "chunk", "start", "length", "difficulty"])

    wanted = segments.select(key, *[F.col(c).cast("double").alias(c) for c in ("start", "end")], F.coalesce(F.col("difficulty"), F.lit(0.0)).cast("double").alias("difficulty"), F.col("total").cast("double").alias("total"))
    return wanted.dropna(subset=["start", "end", "total"]).groupBy(key).applyInArrow(gone_through, f"`{key}` {kind}, chunk int, start double, length double, difficulty double")


def parsed_words(words: Column) -> Column:
    """Words with usable times; probabilities default to 0.9 and are clamped."""
    good = F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull() & (w["start"] >= 0) & (w["end"] >= w["start"]))
    return F.transform(good, lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(w["confidence"], F.lit(0.9)))).alias("confidence")))


def parsed_segment(start: Column, end: Column, log_probability: Column) -> Column:
    """start, end and confidence of a raw segment: times repaired, exp of the clamped log probability."""
    begins = F.greatest(F.lit(0.0), start)
    return F.struct(begins.alias("start"), F.greatest(begins, end).alias("end"), F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(0.0), F.coalesce(log_probability, F.lit(-0.5))))).alias("confidence"))
