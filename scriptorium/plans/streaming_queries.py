"""Batch runs of the incremental operators over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.plans.registry import query, table
from scriptorium.streaming import incremental as I


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_session_counts", "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_session_counts(spark, sf_dir):
    found = I.session_counts(_events(spark, sf_dir))
    return found.select("user_id", "event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("value", 4).alias("value"))


@query("stream_silence_sessions", "SELECT user_id, epoch_us(min(ts)) AS first, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM "
       "(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def stream_silence_sessions(spark, sf_dir):
    found = I.silence_sessions(_events(spark, sf_dir))
    return found.select("user_id", F.unix_micros("session_window.start").alias("first"), "n")
