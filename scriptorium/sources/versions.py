"""Several tables that change as one: buckets are written anew beside the old ones, a manifest names what holds.

A store is a folder with ``data`` and ``manifests``. Each version's manifest lists, for every table, the folder of
each bucket of keys. A change reads the buckets of the keys it names, writes them anew for all tables into a
folder of its own, and at last puts the next manifest in its place under a name that must be free. Until
that moment readers see the version before, after it the new one, and never a mixture; a writer that dies
leaves files that no manifest names, which ``expire`` removes. Of two writers that began from the same version
the second finds its name taken and fails with ``Conflict``, having changed nothing.

The work is Spark's: only names of buckets, as many as the store was made with, pass through the driver. The
folder has to lie where driver and executors reach it, on a file system whose rename does not overwrite.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tables = dict[str, DataFrame]


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines reach; a local session may name none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    return f"{named or tempfile.mkdtemp('-store')}/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


class Store:
    """Tables by name, each with the column that holds the key; all rows of a key change together."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    # ---- files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, files = self._path(name)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json")]

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self.buckets, "tables": {}}
        if version is not None and version not in known:
            raise ValueError(f"no version {version}; there are {known}")
        path, files = self._path(f"manifests/{known[-1] if version is None else version:08d}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The whole text under a name of its own first, so that no reader meets half of it."""
        to, files = self._path(f"manifests/{manifest['version']:08d}.json")
        own, _ = self._path(f"manifests/{uuid.uuid4().hex}.tmp")
        stream = files.create(own, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if files.exists(to) or not files.rename(own, to):
            files.delete(own, False)
            raise Conflict(f"version {manifest['version']} is there already")

    # ---- tables

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def _read(self, manifest: dict, only: set[str] | None = None) -> Tables:
        found = {}
        for name, held in manifest["tables"].items():
            schema = T.StructType.fromJson(held["schema"])
            paths = [f"{self.folder}/{p}" for b, p in held["buckets"].items() if only is None or b in only]
            found[name] = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found

    def read(self, version: int | None = None) -> Tables:
        """All tables of a version, the last one if none is given."""
        return self._read(self._manifest(version))

    def _write(self, tables: Tables, buckets: int, allowed: set[str] | None) -> dict[str, dict]:
        """Write rows by bucket to a new folder; where each bucket of each table now is."""
        place, made = f"data/{uuid.uuid4().hex}", {}
        for name, rows in tables.items():
            placed = rows.withColumn("__bucket", self._bucket(self.keys[name], buckets))
            placed.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{place}/{name}")
            there = [n.split("=")[1] for n in self._names(f"{place}/{name}") if n.startswith("__bucket=")]
            if allowed is not None and not allowed.issuperset(there):
                raise ValueError(f"rows of {name} have keys that the change does not name")
            made[name] = {"schema": rows.schema.jsonValue(), "buckets": {b: f"{place}/{name}/__bucket={b}" for b in there}}
        return made

    def create(self, tables: Tables) -> int:
        """The first version; a store that has one already is a conflict."""
        if set(tables) != set(self.keys):
            raise ValueError("a store needs exactly the tables that it has keys for")
        self._publish({"version": 1, "buckets": self.buckets, "tables": self._write(tables, self.buckets, None)})
        return 1

    def change(self, ids: DataFrame, update: Callable[[Tables], Tables], must_exist: str | None = None) -> int:
        """Put a new version in place and return its number.

        ids: a column of the keys that change, new ones included. update() gets all tables' rows of the buckets
        that hold them, and returns them as they shall be; it may leave tables out that stay as they are. With
        ``must_exist``, a table in which every key has to be already.
        """
        before = self._manifest(None)
        (key,) = ids.columns
        touched = {str(r.b) for r in ids.select(self._bucket(key, before["buckets"]).alias("b")).distinct().toLocalIterator()}  # at most one row for each bucket
        held = self._read(before, touched)
        if must_exist:
            missing = ids.join(held[must_exist].select(F.col(self.keys[must_exist]).alias(key)), key, "left_anti").first()
            if missing is not None:
                raise ValueError(f"{must_exist} has no row with the key {missing[0]}")
        made = self._write(update(held), before["buckets"], touched)
        after = {"version": before["version"] + 1, "buckets": before["buckets"], "tables": dict(before["tables"])}
        for name, new in made.items():
            old = {b: p for b, p in before["tables"][name]["buckets"].items() if b not in touched}
            after["tables"][name] = {"schema": new["schema"], "buckets": old | new["buckets"]}
        self._publish(after)
        return after["version"]

    def expire(self, keep: int = 1) -> list[str]:
        """Remove all but the last versions, and data that no version left names; the removed folders.

        Not while a writer is at work: what it has written is not named yet.
        """
        kept = self.versions()[-keep:]
        named = {p.split("/")[1] for v in kept for t in self._manifest(v)["tables"].values() for p in t["buckets"].values()}
        gone = [f"data/{n}" for n in self._names("data") if n not in named]
        gone += [f"manifests/{n}" for n in self._names("manifests") if n not in {f"{v:08d}.json" for v in kept}]
        for name in gone:
            path, files = self._path(name)
            files.delete(path, True)
        return gone
