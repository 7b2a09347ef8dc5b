"""Log analytics: sessions, their summaries, and what many sessions have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.events import FIELDS

#: Fields that some event has; other fields of a line are left alone.
EVENT = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("word_count", T.LongType()),
        T.StructField("low_conf_count", T.LongType()),
        T.StructField("avg_confidence", T.DoubleType()),
        T.StructField("lowest_conf_words", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("change_count", T.LongType()),
        T.StructField("total_words", T.LongType()),
        T.StructField("corrections_applied", T.LongType()),
        T.StructField("corrections_rejected", T.LongType()),
    ]
)


def read_lines(lines: DataFrame) -> DataFrame:
    """session and event fields of JSON lines (session, line); blank and malformed lines are left out."""
    parsed = lines.where(F.trim("line") != "").withColumn("e", F.from_json("line", EVENT, {"mode": "PERMISSIVE"}))
    return parsed.where("e.event is not null").select("session", "e.*")


def newest(lines: DataFrame, n: int) -> DataFrame:
    """Lines of the n sessions whose names come last."""
    names = lines.select("session").distinct().orderBy(F.col("session").desc()).limit(n)
    return lines.join(names, "session", "left_semi")


def once(events: DataFrame) -> DataFrame:
    """Chunks that two writers logged count once, by session and start time."""
    chunk = F.col("event") == "chunk_transcribed"
    return events.where(chunk).dropDuplicates(["session", "start_time"]).unionByName(events.where(~chunk))


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, or null of nothing."""
    return F.round(F.try_divide(part * 100.0, whole), digits)


def sessions(events: DataFrame) -> DataFrame:
    """Counts of a session's events, its words, and the share of corrections accepted.

    events: session, event, n (words or changes), value.
    """
    is_ = lambda name: F.col("event") == name
    done = events.groupBy("session").agg(
        F.count_if(is_("chunk_transcribed")).alias("chunks"),
        F.sum(F.when(is_("chunk_transcribed"), F.col("n")).otherwise(0)).alias("words"),
        F.count_if(is_("segment_created")).alias("segments"),
        F.sum(F.when(is_("correction_applied"), F.col("n")).otherwise(0)).alias("applied"),
        F.count_if(is_("correction_rejected")).alias("rejected"),
        F.avg(F.when(is_("chunk_transcribed"), F.col("value"))).alias("avg_value"),
    )
    return done.withColumn("acceptance", rate(F.col("applied"), F.col("applied") + F.col("rejected")))


def analysis(summaries: DataFrame) -> DataFrame:
    """One row over all sessions: sums, and the plain mean of the sessions' means."""
    return summaries.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("words").alias("words"), F.sum("applied").alias("applied"), F.sum("rejected").alias("rejected"), F.avg("avg_value").alias("avg_value")
    )


def frequent_doubts(words: DataFrame, threshold: float, n: int) -> DataFrame:
    """The n words most often heard with little confidence, in lower case."""
    counted = words.where(F.col("confidence") < threshold).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "word").limit(n)


def word_stats(words: Column, low: float = 0.7, n: int = 5) -> Column:
    """Of a chunk's words: count, doubtful ones, their share, mean confidence, the n lowest."""
    ordered = F.sort_array(F.transform(words, lambda w: F.struct(w["confidence"].alias("confidence"), w["word"].alias("word"))))
    doubtful = F.size(F.filter(words, lambda w: w["confidence"] < low))
    mean = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.size(words)
    return F.struct(F.size(words).alias("n"), doubtful.alias("n_low"), F.round(doubtful * 100 / F.size(words), 1).alias("low_percent"), F.round(mean, 3).alias("mean"), F.slice(ordered, 1, n).alias("lowest"))


def first_completion(events: DataFrame) -> DataFrame:
    """The first session_complete of each session (by event_id)."""
    w = Window.partitionBy("session").orderBy("event_id")
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def speed(compute: Column, recorded: Column) -> Column:
    """rtf (compute over recorded) and speedup (recorded over compute), 0 where they have no meaning."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return F.struct(ratio(compute, recorded).alias("rtf"), ratio(recorded, compute).alias("speedup"))


def bench_summary(runs: DataFrame) -> DataFrame:
    """Over runs (name, wall, recorded, errors, n_ref): times, their deviation, macro and micro error rates."""
    rtf = F.when(F.col("recorded") > 0, F.col("wall") / F.col("recorded"))
    return runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("wall").alias("avg_wall"),
        F.coalesce(F.stddev_samp("wall"), F.lit(0.0)).alias("stdev_wall"),
        F.min(rtf).alias("min_rtf"),
        F.max(rtf).alias("max_rtf"),
        F.avg(F.when(F.col("n_ref") > 0, F.col("errors") / F.col("n_ref"))).alias("macro_wer"),
        F.try_divide(F.sum("errors"), F.sum("n_ref")).alias("micro_wer"),
    )


KINDS = tuple(FIELDS)


def event_lines(rows: DataFrame, kind: str, fields: dict[str, Column], session: str = "session", at: str = "ts") -> DataFrame:
    """session and line: one JSON event of a kind for each row, with its time and fields; what is missing is
    left out of the line."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of event: {kind}")
    body = F.struct(F.lit(kind).alias("event"), F.col(at).cast("string").alias("ts"), *[c.alias(n) for n, c in fields.items()])
    return rows.select(F.col(session).alias("session"), F.to_json(body).alias("line"))
