"""Whitening against numpy on the same grid, and the contour solver on hard spectra."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rulewright.llm import feast
from rulewright.llm.queries import QUERIES, table
from rulewright.llm.whitening import whiten


def brute(rows, leading=16):
    """(id, component) -> (n, deviation, |whitened|, explained)."""
    grid = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in grid}), object)
    n = len(fit)
    sums = fit.sum(axis=0)
    centred = np.array([[float(Fraction(int(x) * n - int(s), n)) for x, s in zip(r, sums)] for r in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in grid:
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        z = np.array([float(Fraction(a * n - int(s), n)) for a, s in zip(x, sums)]) @ u / np.sqrt(np.maximum(e, 1e-300))
        for k in range(min(leading, len(e))):
            out.setdefault((i, k + 1), []).append((n, dev, abs(z[k]), e[k] / np.trace(v)))
    return out


def same(found, want):
    assert len(found) == sum(map(len, want.values()))
    signs = {}
    for r in found:
        n, dev, z, part = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - z) < 1e-7 and abs(r.explained / part - 1) < 1e-10 and 0 <= r.identity_error < 1e-8
        signs[r.identity_error] = 1
    assert len(signs) == 1


def test_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    same(QUERIES["op13_whitening"](spark, sf).collect(), brute(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.standard_normal(5) * [1, 2, 3, 4, 5] + [0, 0, 50, 0, -7]).tolist()) for k in range(60)]
    rows += [(3, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), (101, [2e4, 2.0, 3.0, 4.0, 5.0])]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows + odd], "vec_id long, embedding array<float>, n int, component string").repartition(5)
    out = whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(out.collect(), brute(rows))


def test_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], schema)).collect() == []
    line = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], schema)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    # A deviation beyond 64 bits is null.
    far = whiten(spark.createDataFrame([(k, [3e38 * (k % 2), float(k)]) for k in range(4)], schema)).collect()
    assert {r.deviation for r in far} == {None}


SPECTRA = {
    "random": np.sort(np.random.default_rng(1).random(40))[::-1],
    "cluster at the cut": np.r_[np.full(20, 5.0), np.arange(20) / 30],
    "identity": np.ones(40),
    "falling": 10.0 ** -np.arange(40),
    "three": np.r_[np.ones(3), np.zeros(37)],
    "spike": np.r_[1e6, np.linspace(2, 1, 39)],
    "near pairs": np.repeat(np.arange(20, 0, -1.0), 2) + np.tile([1e-6, 0], 20),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs(name):
    values = SPECTRA[name]
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((40, 40)))[0]
    a = (q * values) @ q.T
    e, v = feast.leading_pairs(a, 16)
    top = values[0]
    many = min(16, int((values > 1e-12 * top).sum()))
    assert len(e) >= many and np.abs(e[:many] - values[:many]).max() < 1e-13 * top
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13 * top


def test_inertia_and_missing_pairs():
    a = np.diag([1.0, 2.0, 2.0, 3.0])
    d, off = feast.tridiagonal(a)
    assert [feast.below(d, off, s) for s in (0.5, 1.5, 2.5, 3.5)] == [0, 1, 3, 4]
    assert len(feast.leading_pairs(np.zeros((3, 3)), 16)[0]) == 0 and feast.leading_pairs(np.array([[4.0]]), 16)[0] == [4.0]
    with pytest.raises(ArithmeticError):  # more than there are
        feast._interval_pairs(a, 1.5, 2.5, 3, np.random.default_rng(0))
