"""Learning queues as arbitrary stateful streams: what is pending lives in keyed state, not in a file.

Both take a streaming DataFrame and give one; state is kept by key in RocksDB, changes with each batch and comes
back from the checkpoint after a restart. """

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.functions.text import valid_term
from scriptorium.operators.learning import PROMOTE_FROM

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROMOTED = "entry_id string, alias string, occurrences long"
QUEUE = "term string, domain string, occurrences long, sources array<string>, change string"


def with_state_store(spark: SparkSession) -> None:
    """Keyed state of several columns needs the store on disk; has to be set before a stream begins."""
    spark.conf.set(_STORE, _ROCKS)


def _milliseconds(time: timedelta) -> int:
    return int(time.total_seconds() * 1000)


class _Aliases(StatefulProcessor):
    """Counts one alias of one entry; the count is dropped when the alias is promoted or known."""

    def __init__(self, least: int, idle_ms: int | None):
        self.least, self.idle_ms = least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long, alias string", self.idle_ms)
        self.known = handle.getValueState("known", "known boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            for _ in rows:
                pass
            return
        n, last = self.count.get() if self.count.exists() else (0, None)
        for part in rows:
            for alias in part["alias"]:
                if n >= self.least:
                    break  # already an alias
                n, last = n + 1, alias
        if n >= self.least:
            self.count.clear()
            self.known.update((True,))
            yield pd.DataFrame({"entry_id": [key[0]], "alias": [last], "occurrences": [n]})
        elif last is not None:
            self.count.update((n, last))

    def close(self) -> None:
        pass


def promoted_aliases(sightings: DataFrame, known: DataFrame, least: int = PROMOTE_FROM, idle: timedelta | None = None) -> DataFrame:
    """entry_id, alias, occurrences: each alias in the batch in which it was heard ``least`` times for its entry.

    sightings: entry_id, alias. known: entry_id, alias of what entries are called already, which is never
    counted. Aliases are told apart in any case without blanks at their ends; empty and null ones are none. After
    promotion an alias is known. With ``idle``, a count that nothing was added to for that time is forgotten; time
    is then that of processing, so a batch runs at each trigger, with or without rows.
    """
    low = F.lower(F.trim("alias"))
    told = lambda rows: rows.where((F.trim("alias") != "") & F.col("entry_id").isNotNull()).select(F.col("entry_id").cast("string").alias("entry_id"), low.alias("low"), F.trim("alias").alias("alias"))
    with_state_store(sightings.sparkSession)
    return (
        told(sightings)
        .groupBy("entry_id", "low")
        .transformWithStateInPandas(_Aliases(least, _milliseconds(idle) if idle else None), PROMOTED, "append", "processingTime" if idle else "none", initialState=told(known).dropDuplicates(["entry_id", "low"]).groupBy("entry_id", "low"))
    )


class _Terms(StatefulProcessor):
    """One term of the queue: how often, for which domain, from which sources; it goes when its timer fires."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n long, domain string, last long")
        self.sources = handle.getMapState("sources", "source string", "n long")

    def _row(self, key, n: int, domain: str | None, change: str) -> pd.DataFrame:
        names = sorted(k[0] for k in self.sources.keys())
        return pd.DataFrame({"term": [key[0]], "domain": [domain], "occurrences": [n], "sources": [names], "change": [change]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows), ignore_index=True)
        n, domain, last = self.held.get() if self.held.exists() else (0, None, 0)
        new = not n
        first = found.sort_values(["ts", "domain"], na_position="last").iloc[0]
        domain = first["domain"] if new else domain
        for source, times in found["source"].dropna().value_counts().items():
            before = self.sources.getValue((source,))[0] if self.sources.containsKey((source,)) else 0
            self.sources.updateValue((source,), (before + int(times),))
        last = max(last, int(found["ts"].max().timestamp() * 1000))
        self.held.update((n + len(found), domain, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield self._row(key, n + len(found), domain, "added" if new else "updated")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, domain, _ = self.held.get()
        yield self._row(key, n, domain, "forgotten")
        self.held.clear()
        self.sources.clear()

    def close(self) -> None:
        pass


def pending_terms(sightings: DataFrame, idle: timedelta = timedelta(days=30), late: str = "1 day") -> DataFrame:
    """term, domain, occurrences, sources, change: the state of each term of the queue after each batch that touched
    it (added, updated), and at last when it was not seen for ``idle`` of event time (forgotten).

    sightings: term, domain, source, ts. Terms that are not valid are not counted. A term keeps the domain of its
    first sighting. Sightings that come later than ``late`` behind the newest are no longer counted; null sources
    are none.
    """
    good = sightings.where(valid_term(F.col("term")) & F.col("ts").isNotNull()).select("term", "domain", "source", "ts").withWatermark("ts", late)
    with_state_store(sightings.sparkSession)
    return good.groupBy("term").transformWithStateInPandas(_Terms(_milliseconds(idle)), QUEUE, "update", "eventTime")
