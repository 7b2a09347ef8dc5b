"""Near duplicates by signatures against brute force, and the signatures' own chances."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from scriptorium.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """(id, size, smallest id, kept, links) by all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    met = [[j for j, b in enumerate(sets) if j != i and (n := len(a & b)) and 100 * n >= 85 * (len(a) + len(b) - n)] for i, a in enumerate(sets)]
    out = []
    for i, (key, _) in enumerate(rows):
        held, todo = {i}, [i]
        while todo:
            new = set(met[todo.pop()]) - held
            held |= new
            todo += new
        least = key if not sets[i] else min((rows[j][0] for j in held if rows[j][0] is not None), default=None)
        out.append((key, len(sets[i]), least, key == least, len(met[i])))
    return Counter(out)


def found(docs, **how):
    return Counter(map(tuple, minhash.near_duplicates(docs, **how).select("doc_id", "n_shingles", "component_id", "kept", "n_links").collect()))


@pytest.mark.parametrize("which", ["odd", "none", "copies"])
@pytest.mark.parametrize("block, held", [(1_000_000, 1_000_000), (300, 100)])
def test_equals_brute_force(which, block, held, request, monkeypatch):
    monkeypatch.setattr(minhash, "HELD", held)
    docs = request.getfixturevalue(which)
    assert found(docs, block_shingles=block) == plain([(r.doc_id, r.text) for r in docs.collect()])


def edited(rng, words, n):
    made = list(words)
    for _ in range(n):
        made[rng.randrange(len(made))] = f"e{rng.randrange(10**6)}"
    return " ".join(made)


def test_every_link_of_texts_around_the_threshold(spark):
    """Chains of edits, short texts and long ones: similarities on both sides of 0.85."""
    rng = random.Random(9)
    rows = []
    for size in (4, 6, 7, 8, 12, 20, 60, 150, 400, 1_500):
        base = [f"s{size}w{i}" for i in range(size)]
        rows += [(len(rows) + i, edited(rng, base, n)) for i, n in enumerate([0, 0, 0, 1, 1, 1, 2, 2, *[max(1, size // 60)] * 12, *[max(1, size // 45)] * 6])]
        rows += [(len(rows) + i, " ".join(base[i:])) for i in range(3)]
    want = plain(rows)
    assert sum(n for (*_, n), _ in want.items()) > 200
    for how in ({}, {"block_shingles": 2_000}):
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **how) == want


def test_sql_states_the_same(copies):
    con = duckdb.connect()
    con.register("documents", copies.select("doc_id", "text").toPandas())
    got = con.execute(minhash.ORACLE).df()
    assert Counter(map(tuple, got.itertuples(index=False))) == plain([(r.doc_id, r.text) for r in copies.collect()])


@pytest.mark.parametrize("size", [1, 5, 40, 600, 5_000])
def test_bins_agree_as_often_as_sets_are_alike(size):
    rng = np.random.default_rng(size)
    share = []
    for _ in range(60):
        both = np.unique(rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2))
        a, b = both[: len(both) * 9 // 10], np.sort(rng.permutation(both)[: len(both) * 9 // 10])
        if not len(a):
            continue
        x, y = minhash.signatures([a, b])
        assert np.isin(x, a).all() and set(x.tolist()) == set(minhash.signatures([a])[0].tolist())
        share.append((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert not share or abs(np.mean(share)) < 0.03


def test_stars_have_one_edge_for_each_member():
    names = np.array([5, 5, 5, 7, 9, 9], np.uint64)
    assert [x.tolist() for x in minhash.stars(names, np.array([3, 1, 2, 8, 4, 4]))] == [[5, 7, 9], [1, 8, 4], [1, 1], [2, 3]]
