"""The incremental parts as Structured Streaming: session summaries, learning queues, gaps in time.

Each takes a streaming DataFrame and gives one; a batch DataFrame works as well. State is bounded by
watermarks, or by keys that are dropped once they are promoted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and sums of events by user, kind and window of event time."""
    marked = events.withWatermark(at, late)
    return marked.groupBy(F.window(at, window), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def silence_sessions(events: DataFrame, at: str = "ts", gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap; a run is given out once the watermark has passed it."""
    marked = events.withWatermark(at, late)
    return marked.groupBy(F.session_window(at, gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def promotions(sightings: DataFrame, least: int = 3) -> DataFrame:
    """key, occurrences: each term once, in the batch in which it has been seen ``least`` times.

    sightings: key. A promoted key's count is dropped, as in the batch queue, so that it can be seen anew.
    """

    def counted(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        if n >= least:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "occurrences": [n]})
        else:
            state.update((n,))

    return sightings.groupBy("key").applyInPandasWithState(counted, "key string, occurrences long", "n long", "append", GroupStateTimeout.NoTimeout)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """A running query that appends events as JSON lines."""
    return events.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).start(path)
