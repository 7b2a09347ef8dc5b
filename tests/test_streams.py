"""Streams with late rows and restarts against batch results."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import learning as L
from scriptorium.streaming import counters, incremental


class Folder:
    """A folder of JSON files that a stream reads one by one, and what came out of each run."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n, self.rows = spark, path, schema, 0, []
        (path / "in").mkdir()

    def add(self, rows):
        names = [c.split()[0] for c in self.schema.split(", ")]
        (self.path / "in" / f"{self.n:04d}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True)), default=str) for r in rows))
        self.n += 1

    def run(self, build, mode):
        """All files that are new, one in each batch, from the checkpoint of the run before."""
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))
        out = build(source).writeStream.outputMode(mode).option("checkpointLocation", str(self.path / "checkpoint")).trigger(availableNow=True)
        out = out.foreachBatch(lambda df, _: self.rows.append([r.asDict() for r in df.collect()]))
        running = out.start()
        try:
            assert running.awaitTermination(100)
        finally:
            running.stop()


@pytest.fixture
def folder(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield lambda schema: Folder(spark, tmp_path, schema)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_aliases_are_promoted_once_across_restarts(spark, folder):
    rng = random.Random(3)
    known = spark.createDataFrame([("e1", "known as"), ("e2", "x")], "entry_id string, alias string")
    stream = folder("entry_id string, alias string")
    build = lambda s: counters.promoted_aliases(s, known)
    said = [(f"e{rng.randrange(4)}", rng.choice(["Foo", "foo ", "bar", " x", "Known As", "", "rare"])) for _ in range(60)] + [("e9", "twice")] * 2 + [(None, "no entry"), ("e3", None)]
    for k in range(0, len(said), 16):
        stream.add(said[k : k + 16])
        if k in (16, 48):
            stream.run(build, "append")
    stream.run(build, "append")
    found = [(r["entry_id"], r["alias"].lower()) for rows in stream.rows for r in rows]
    # what the batch queue promotes, less what was an alias before
    rows = spark.createDataFrame(said, "entry_id string, alias string").where("trim(alias) != '' and entry_id is not null").withColumn("alias", F.trim("alias"))
    batch = {(r.entry_id, r.alias) for r in L.alias_counts(rows).where("promoted").collect()} - {("e1", "known as"), ("e2", "x")}
    assert len(found) == len(set(found)) and set(found) == batch and len(batch) > 3
    assert all(r["occurrences"] == 3 for rows in stream.rows for r in rows)
    # a promoted alias is not pending any more
    stream.add([(e, a) for e, a in batch] * 5)
    stream.run(build, "append")
    assert [r for rows in stream.rows for r in rows][len(found) :] == []


def test_pending_terms_with_late_rows_and_restart(spark, folder):
    rng = random.Random(5)
    day = datetime(2024, 1, 1)
    stream = folder("term string, domain string, source string, ts timestamp")
    build = lambda s: counters.pending_terms(s, idle=timedelta(days=10), late="2 days")
    counted = []
    newest = day
    for k in range(6):
        rows = [(rng.choice(["Anna", "Bob Li", "x", "7", "Zoë"]), rng.choice(["names", "tech", None]), rng.choice(["a", "b", "c", None]), day + timedelta(days=k, seconds=rng.randrange(80_000))) for _ in range(15)]
        counted += rows
        late = [("Anna", "late", "z", newest - timedelta(days=4))] if k > 2 else []
        stream.add(rows + late)
        newest = max(r[3] for r in rows)
        if k == 2:
            stream.run(build, "update")
    stream.run(build, "update")
    last = {}
    for rows in stream.rows:
        last |= {r["term"]: r for r in rows}
    want = defaultdict(list)
    for term, *rest in counted:
        want[term].append(rest)
    assert set(last) == {"Anna", "Bob Li", "Zoë"}
    for term, r in last.items():
        sources = sorted({s for _, s, _ in want[term] if s})
        assert (r["occurrences"], r["sources"], r["change"]) == (len(want[term]), sources, "updated")
    # the same totals as the batch queue
    batch = L.queue(spark.createDataFrame([(t, s, i) for i, (t, _, s, _) in enumerate(counted)], "term string, source string, pos long"), F.col("term"))
    assert {r.key: r.occurrences for r in batch.where("key in ('Anna', 'Bob Li', 'Zoë')").collect()} == {t: r["occurrences"] for t, r in last.items()}
    # a term that is not seen for long is given out once more and forgotten
    stream.add([("Anna", "new", "q", day + timedelta(days=40))])
    stream.add([("Anna", "new", "q", day + timedelta(days=41))])
    before = len(stream.rows)
    stream.run(build, "update")
    late = [r for rows in stream.rows[before:] for r in rows]
    assert sorted((r["term"], r["occurrences"]) for r in late if r["change"] == "forgotten" and r["term"] != "Anna") == sorted((t, last[t]["occurrences"]) for t in ("Bob Li", "Zoë"))


def test_windows_wait_for_late_events(spark, folder):
    day = datetime(2024, 1, 1)
    stream = folder("user_id long, event_type string, ts timestamp, value double")
    build = lambda s: incremental.session_counts(s, late="2 hours")
    stream.add([(1, "a", day + timedelta(hours=h), 1.0) for h in (1, 2, 23)])
    stream.run(build, "append")
    stream.add([(1, "a", day + timedelta(hours=22), 1.0), (1, "a", day + timedelta(hours=25), 1.0)])
    stream.run(build, "append")
    stream.add([(1, "a", day + timedelta(hours=30), 1.0)])
    stream.add([(1, "a", day + timedelta(hours=31), 1.0)])
    stream.add([(1, "a", day + timedelta(hours=3), 1.0), (1, "a", day + timedelta(hours=60), 1.0)])  # the first is too late
    stream.run(build, "append")
    closed = Counter((str(r["window"].start)[:10], r["n"]) for rows in stream.rows for r in rows)
    assert closed == {("2024-01-01", 4): 1, ("2024-01-02", 3): 1}


def test_events_are_appended_as_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event": "error", "message": "x"}\n{"event": "config"}')
    stream = spark.readStream.schema("event string, message string").json(str(tmp_path / "in"))
    running = incremental.append_events(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    running.processAllAvailable()
    (tmp_path / "in" / "b.json").write_text('{"event": "error", "message": "y"}')
    running.processAllAvailable()
    running.stop()
    # started again from its checkpoint it writes nothing twice
    running = incremental.append_events(spark.readStream.schema("event string, message string").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    running.processAllAvailable()
    running.stop()
    assert Counter(r.message for r in spark.read.schema("event string, message string").json(str(tmp_path / "out")).collect()) == {"x": 1, "y": 1, None: 1}
