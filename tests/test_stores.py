"""Stores of vocabularies, profiles, waiting terms and seeds: written, read again, refused."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pytest

from scriptorium.operators import logs, ranking
from scriptorium.sources import files, stores


def test_domains_are_written_sorted_and_counted(tmp_path):
    folder = str(tmp_path / "v")
    assert stores.domain_terms(folder, "tech") == [] and stores.save_domain(folder, "tech", ["b", "a", "b"], "now") == 3
    assert stores.save_domain(folder, "tech", ["a", "c"], "now") == 1 and stores.domain_terms(folder, "tech") == ["a", "b", "c"]
    lines = (tmp_path / "v" / "tech.txt").read_text().splitlines()
    assert lines[:3] == ["# Vocabulary for domain: tech", "# Updated: now", ""] and (tmp_path / "v" / "tech.txt").stat().st_mode & 0o777 == 0o600
    assert stores.save_domain(folder, "tech", ["z"], "now", append=False) == 1 and stores.domain_terms(folder, "tech") == ["z"]
    assert stores.remove_domain(folder, "tech") and not stores.remove_domain(folder, "tech") and not stores.remove_domain(folder, "../x")
    for name in ("", "..", "config", "pending_vocabulary", "a/b", "x" * 65):
        with pytest.raises(ValueError):
            stores.save_domain(folder, name, [], "now")
    assert files.valid_domain("été_1") and not files.valid_domain("a b")


def test_profiles_round_trip(tmp_path):
    made = ranking.Profile("run-1", ("A", "B"), ("running",), 20, 1.5, "x")
    stores.save_profile(str(tmp_path), made)
    assert files.profile((tmp_path / "run-1.json").read_text()) == made and files.profiles(str(tmp_path)) == ["run-1"]
    assert stores.delete_profile(str(tmp_path), "run-1") and not stores.delete_profile(str(tmp_path), "run-1")
    with pytest.raises(ValueError):
        stores.save_profile(str(tmp_path), ranking.Profile("../x"))


def test_resources():
    @dataclass(frozen=True)
    class Config:
        max_parallel_chunks: int = 9
        other: str = "kept"

    assert stores.with_resources(Config(), "batch") == (Config(2), True) and stores.with_resources(Config(), "interactive") == (Config(1), False)
    with pytest.raises(ValueError):
        stores.with_resources(Config(), "none")


def test_waiting_terms_round_trip(spark, tmp_path):
    path = str(tmp_path / "pending")
    assert stores.load_pending(spark, path).count() == 0
    queue = spark.createDataFrame([("Suunto", "tech", 3, ["a", "b"]), ("été", None, 1, [])], stores.PENDING)
    stores.save_pending(queue, path)
    assert sorted(map(tuple, stores.load_pending(spark, path).collect()), key=str) == sorted(map(tuple, queue.collect()), key=str)


def test_seeds_skip_what_exists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"canonical": " Garmin ", "tier": "a"}, {"canonical": "Suunto", "type": "product"}]))
    (tmp_path / "b.json").write_text(json.dumps({"entries": [{"canonical": "garmin"}, {"canonical": "Strava", "tier": "Z"}, {"canonical": " "}]}))
    existing = spark.createDataFrame([("SUUNTO",)], "canonical string")
    found = {r.canonical: r.tier for r in stores.seeds(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], existing).collect()}
    assert found == {"Garmin": "A", "Strava": "D"}


def test_event_kinds_and_keywords(spark):
    rows = spark.createDataFrame([("s", "t", 5, None)], "session string, ts string, n long, x double")
    (line,) = logs.event_lines(rows, "pass_complete", {"change_count": rows.n, "x": rows.x}).collect()
    assert json.loads(line.line) == {"event": "pass_complete", "ts": "t", "change_count": 5}
    with pytest.raises(ValueError):
        logs.event_lines(rows, "other", {})
    assert ranking.with_keywords({"a": ("x",)}, "a", [" X", "y", ""]) == {"a": ("x", "y")} and ranking.with_keywords({}, "b", ["Q"]) == {"b": ("q",)}
    paths = spark.createDataFrame([("a",), (" ",), (None,)], "p string")
    assert [r[0] for r in paths.select(stores.has_path(paths.p)).collect()] == [True, False, False]
