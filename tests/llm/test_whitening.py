"""Whitening against a plain eigendecomposition in exact and double arithmetic."""

from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def plain(rows, most=8):
    """(id, component): (n, deviation, whitened up to sign, explained) by the covariance's eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return {}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    exact = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    y = np.array([[float(Fraction(c, n)) for c in r] for r in exact])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, _), row, whole in zip(kept, y, exact, strict=True):
        for k in range(min(most, d)):
            out.setdefault((i, k + 1), []).append((n, sum(c * c for c in whole), abs(row @ vectors[:, k]) / math.sqrt(max(values[k], 1e-300)), values[k] / values.sum()))
    return out


def rows_of(rng, n, d):
    scale = np.linspace(3, 0.2, d)
    return [(i, [float(np.float32(c)) for c in rng.normal(0.3, 1, d) * scale]) for i in range(n)]


def framed(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("fan_in, block", [(None, 1 << 20), (2, 40)])
def test_equals_a_plain_eigendecomposition(spark, fan_in, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", block)
    rows = rows_of(np.random.default_rng(3), 60, 12)
    rows += [rows[0], (7, rows[7][1])]  # repeated rows count twice
    odd = [(100, None), (101, [None] * 12), (102, [math.nan] + [0.0] * 11), (103, [math.inf] * 12), (104, []), (105, [1.0]), (None, rows[5][1])]
    want = plain(rows + [(None, rows[5][1])])
    found = whitening.whitened(framed(spark, rows + odd, 7), fan_in=fan_in).collect()
    assert Counter((r.vec_id, r.component) for r in found) == Counter({k: len(v) for k, v in want.items()})
    signs = {}
    for r in found:
        n, deviation, size, share = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation, r.deviation_exact) == (n, deviation, str(deviation))
        assert abs(r.whitened) == pytest.approx(size, rel=1e-8, abs=1e-9) and r.explained == pytest.approx(share, rel=1e-9)
        assert r.identity_error < 1e-9
        signs.setdefault(r.component, []).append(r.whitened)
    values = np.array([signs[k] for k in sorted(signs)])
    assert np.allclose(values @ values.T / values.shape[1], np.eye(8), atol=1e-9)


def test_orthogonal_basis_survives_a_bad_condition(spark):
    """Dimensions of very unlike sizes: the covariance's own eigenvectors would lose the small ones."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 3) * (3e5, 1, 0.05)]) for i in range(200)]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whitened(rows).collect()
    assert {r.component for r in found} == {1, 2, 3} and max(r.identity_error for r in found) < 1e-6


def test_components_without_variance_have_no_value(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    found = whitening.whitened(framed(spark, rows)).collect()
    by = {k: [r.whitened for r in found if r.component == k] for k in (1, 2, 3)}
    assert None not in by[1] and set(by[2]) == set(by[3]) == {None}
    assert {round(r.explained, 12) for r in found} == {1.0, 0.0} and max(r.identity_error for r in found) < 1e-9
    same = whitening.whitened(framed(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert Counter((r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == {(1, 1, 0, None, None, 0.0): 3, (1, 2, 0, None, None, 0.0): 3}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**39 - i), float(i)]) for i in range(4)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = plain(rows)
    assert all(r.deviation_exact == str(want[r.vec_id, r.component][0][1]) for r in found)
    wide = whitening.whitened(spark.createDataFrame([(i, [float(i % 2) * 2.0**39]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert {(r.deviation, r.deviation_exact) for r in wide} == {(None, str((2**39 * 1024 * 2) ** 2))}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(framed(spark, rows, 1)).count() == 0


def test_one_long_vector(spark):
    rows = [(1, [0.5] * 3_000), (2, [0.25] * 3_000)]
    found = whitening.whitened(framed(spark, rows, 2)).collect()
    assert len(found) == 16 and sorted(round(abs(r.whitened), 9) for r in found if r.component == 1) == [1.0, 1.0]
