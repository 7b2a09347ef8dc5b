"""Small stores that users keep beside the tables: vocabularies by domain, profiles, waiting terms, seeds.

They are configuration: a file for each domain or profile, read and written by the driver. Terms that
wait and seeds are tables, and Spark reads and writes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.dictionary import clean_import, new_entries
from scriptorium.operators.ranking import Profile
from scriptorium.sources.files import dictionary_json, valid_domain

PENDING = "term string, domain string, occurrences long, sources array<string>"
#: Resource settings by name, (chunks at once, word timestamps).
RESOURCES = {"interactive": (1, False), "balanced": (1, True), "batch": (2, True)}
#: How many terms of each list a domain takes, None for all.
SELECTION = {
    "biography": (("first_names", 200), ("last_names", 200), ("historians", None)),
    "technical": (("companies", None), ("products", None), ("programming", None)),
    "medical": (),
    "legal": (),
}
GENERAL = (("first_names", 100), ("last_names", 100))


def _file(folder: str, name: str, suffix: str) -> Path:
    if not valid_domain(name):
        raise ValueError(f"no name for a domain: {name!r}")
    return Path(folder) / f"{name}{suffix}"


def _private(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    path.chmod(0o600)


def domain_terms(folder: str, name: str) -> list[str]:
    """The terms of a domain's file; none for a name that is not valid or has no file."""
    path = Path(folder) / f"{name}.txt"
    if not valid_domain(name) or not path.exists():
        return []
    lines = (line.strip() for line in path.read_text(encoding="utf-8").splitlines())
    return [line for line in lines if line and not line.startswith("#")]


def save_domain(folder: str, name: str, terms: Iterable[str], when: str, append: bool = True) -> int:
    """Write a domain's terms, sorted and once each, under a header; how many of those given are new."""
    terms = list(terms)
    held = set(domain_terms(folder, name)) if append else set()
    lines = [f"# Vocabulary for domain: {name}", f"# Updated: {when}", "", *sorted(held | set(terms))]
    _private(_file(folder, name, ".txt"), "\n".join(lines) + "\n")
    return sum(t not in held for t in terms)


def remove_domain(folder: str, name: str) -> bool:
    """Whether there was such a domain's file, which is gone."""
    path = Path(folder) / f"{name}.txt"
    if not valid_domain(name) or not path.exists():
        return False
    path.unlink()
    return True


def save_profile(folder: str, profile: Profile) -> None:
    if not profile.name or not all(c.isalnum() or c in "_-" for c in profile.name):
        raise ValueError(f"no name for a profile: {profile.name!r}")
    _private(Path(folder) / f"{profile.name}.json", json.dumps(asdict(profile), indent=2))


def delete_profile(folder: str, name: str) -> bool:
    path = Path(folder) / f"{name}.json"
    if not all(c.isalnum() or c in "_-" for c in name) or not path.exists():
        return False
    path.unlink()
    return True


def with_resources(config, name: str):
    """The configuration (a dataclass with max_parallel_chunks) under a resource setting, and whether words
    get time stamps."""
    if name not in RESOURCES:
        raise ValueError(f"no such amount of resources: {name!r}; there are {', '.join(RESOURCES)}")
    chunks, stamps = RESOURCES[name]
    return replace(config, max_parallel_chunks=chunks), stamps


def load_pending(spark: SparkSession, path: str) -> DataFrame:
    """Waiting terms of a store; a store that is not there or is no store has none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], PENDING)
    return spark.read.schema(PENDING).option("mode", "DROPMALFORMED").json(path)


def save_pending(queue: DataFrame, path: str) -> None:
    queue.select("term", "domain", "occurrences", "sources").write.mode("overwrite").json(path)


def seeds(spark: SparkSession, paths: list[str], existing: DataFrame) -> DataFrame:
    """New entries of seed files, cleaned, without those that exist; counts by tier tell what was loaded."""
    rows = dictionary_json(spark, paths[0])
    for path in paths[1:]:
        rows = rows.unionByName(dictionary_json(spark, path))
    return new_entries(clean_import(rows), existing)


def selected_terms(lists: DataFrame, domain: str) -> DataFrame:
    """term of the word lists (list, pos, term) that a domain takes, in the order of its lists; pos counts
    from 0."""
    wanted = SELECTION.get(domain, GENERAL)
    keep, place = F.lit(False), F.lit(None).cast("int")
    for i, (name, most) in enumerate(wanted):
        here = (F.col("list") == name) & (F.lit(True) if most is None else F.col("pos") < most)
        keep, place = keep | here, F.when(here, i).otherwise(place)
    return lists.where(keep).orderBy(place, "pos").select("list", "pos", "term")


def has_path(path: Column) -> Column:
    """Whether a transcript names its recording."""
    return F.coalesce(F.trim(path) != "", F.lit(False))
