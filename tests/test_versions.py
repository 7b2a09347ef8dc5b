"""A store of several tables shows one version or the next, whatever becomes of the writer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import dictionary as D
from scriptorium.sources import versions

KEYS = {"entries": "id", "aliases": "entry_id", "pronunciations": "entry_id", "contexts": "entry_id"}


@pytest.fixture
def store(spark, tmp_path):
    made = versions.Store(spark, str(tmp_path / "store"), KEYS, buckets=7)
    ids = spark.range(50)
    made.create(
        {
            "entries": ids.selectExpr("id", "concat('name ', id) as canonical", "'D' as tier"),
            "aliases": ids.selectExpr("id as entry_id", "explode(array(concat('a', id), concat('b', id))) as alias"),
            "pronunciations": ids.where("id < 5").selectExpr("id as entry_id", "'x' as ipa"),
            "contexts": ids.selectExpr("id as entry_id", "'talk' as context"),
        }
    )
    return made


def state(store, version=None):
    return {name: sorted(map(tuple, rows.collect())) for name, rows in store.read(version).items()}


def replaced(spark, ids):
    """All four tables with new values for some entries, as an update of an entry makes them."""
    some = spark.createDataFrame([(i,) for i in ids], "id long")

    def update(held):
        mine = some.withColumnRenamed("id", "entry_id")
        return {
            "entries": D.patched(held["entries"], some.withColumn("tier", F.lit("A")), ("tier",)),
            "aliases": D.replaced(held["aliases"], mine.withColumn("alias", F.concat(F.lit("new "), "entry_id"))),
            "pronunciations": D.replaced(held["pronunciations"], mine.withColumn("ipa", F.lit("y"))),
            "contexts": held["contexts"].join(mine, "entry_id", "left_anti"),
        }

    return some, update


def expected(before, ids):
    return {
        "entries": [(i, c, "A" if i in ids else t) for i, c, t in before["entries"]],
        "aliases": sorted([r for r in before["aliases"] if r[0] not in ids] + [(i, f"new {i}") for i in ids]),
        "pronunciations": sorted([r for r in before["pronunciations"] if r[0] not in ids] + [(i, "y") for i in ids]),
        "contexts": [r for r in before["contexts"] if r[0] not in ids],
    }


def test_all_tables_change_as_one(spark, store):
    before = state(store)
    assert store.change(*replaced(spark, [3, 17]), must_exist="entries") == 2
    assert state(store) == expected(before, [3, 17])
    assert state(store, 1) == before and store.versions() == [1, 2]
    # buckets without changed keys are the same files
    old, new = (store._manifest(v)["tables"]["entries"]["buckets"] for v in (1, 2))
    assert 0 < sum(old[b] != new[b] for b in old) <= 2


@pytest.mark.parametrize("at", [0, 1, 3])
def test_a_writer_that_dies_between_tables_changes_nothing(spark, store, at, monkeypatch):
    before, write, done = state(store), versions.Store._names, []

    def dies(self, name):
        if name.startswith("data/") and "/" in name[5:]:
            done.append(name)
            if len(done) > at:
                raise KeyboardInterrupt
        return write(self, name)

    monkeypatch.setattr(versions.Store, "_names", dies)
    with pytest.raises(KeyboardInterrupt):
        store.change(*replaced(spark, [3, 17]))
    monkeypatch.undo()
    assert state(store) == before and store.versions() == [1]
    assert len(store.expire()) == 1 and state(store) == before
    assert store.change(*replaced(spark, [3])) == 2


def test_a_writer_that_dies_before_the_manifest_changes_nothing(spark, store, monkeypatch):
    before = state(store)
    monkeypatch.setattr(versions.Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        store.change(*replaced(spark, [4]))
    monkeypatch.undo()
    assert state(store) == before


def test_of_two_writers_one_fails(spark, store):
    before = state(store)
    ids, update = replaced(spark, [8])

    def late(held):
        store.change(*replaced(spark, [9]))  # another writer is faster
        return update(held)

    with pytest.raises(versions.Conflict):
        store.change(ids, late)
    assert state(store) == expected(before, [9])


def test_keys_that_are_missing_or_not_named(spark, store):
    before = state(store)
    with pytest.raises(ValueError, match="no row with the key 999"):
        store.change(*replaced(spark, [999]), must_exist="entries")
    with pytest.raises(ValueError, match="does not name"):
        store.change(spark.range(1), lambda held: {"contexts": spark.range(50).selectExpr("id as entry_id", "'x' as context")})
    with pytest.raises(ValueError, match="no version 9"):
        store.read(9)
    with pytest.raises(versions.Conflict):
        store.create(store.read())
    assert state(store) == before


def test_new_rows_emptied_tables_and_old_versions(spark, store):
    everything = store.read()["entries"].select("id")
    assert store.change(spark.createDataFrame([(777,)], "id long"), lambda held: {"entries": held["entries"].unionByName(spark.createDataFrame([(777, "new", "B")], "id long, canonical string, tier string"))}) == 2
    assert (777, "new", "B") in state(store)["entries"]
    assert store.change(everything, lambda held: {n: rows.where(F.lit(False)) for n, rows in held.items() if n != "entries"}) == 3
    found = state(store)
    assert len(found["entries"]) == 51 and not found["aliases"] and not found["contexts"]
    store.expire()
    assert store.versions() == [3] and state(store) == found
    assert store.change(spark.createDataFrame([], "id long"), lambda held: held) == 4 and state(store) == found
