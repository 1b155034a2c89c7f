"""Whitening against NumPy's dense eigendecomposition."""
import math

import numpy as np
import pytest

from pricewise.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, components=W.COMPONENTS):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return n, dev, ((x - s / n) @ q[:, :k]) / np.sqrt(e[:k]), e[:k] / e.clip(0).sum()


def check(got, ids, want, rtol=1e-7):
    n, dev, w, explained = want
    k = w.shape[1]
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, rows in by.items():
        rows.sort(key=lambda r: r["vec_id"])
        assert [r["vec_id"] for r in rows] == ids
        assert {r["n"] for r in rows} == {n} and [r["deviation"] for r in rows] == dev
        assert all(math.isclose(r["explained"], explained[c - 1], rel_tol=1e-8) for r in rows)
        assert all(r["identity_error"] < 1e-8 for r in rows)
        mine, theirs = np.array([r["whitened"] for r in rows]), w[:, c - 1]
        sign = np.sign(mine @ theirs)
        np.testing.assert_allclose(mine * sign, theirs, rtol=0, atol=rtol * np.abs(theirs).max())


def table(seed, n, d, rank=None):
    rng = np.random.default_rng(seed)
    scale = 1.0 / np.arange(1, d + 1) ** 0.5
    x = rng.standard_normal((n, d)) * scale
    if rank:
        x = rng.integers(-3, 4, (n, rank)) @ rng.integers(-2, 3, (rank, d))
    return [[float(v) for v in row] for row in x.astype(np.float32)]


@pytest.mark.parametrize("n, d, rank", [(400, 48, None), (60, 5, None), (300, 40, 3), (12, 40, None)])
def test_equals_dense_eigenvectors(spark, n, d, rank):
    vectors = table(n + d, n, d, rank)
    vectors += [vectors[0]] * (n // 2)  # repeated rows count once in the fit
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    check(got, list(range(len(rows))), plain(vectors))


def test_unusable_rows_are_dropped(spark):
    good = table(3, 50, 4)
    rows = [(i, v, 0) for i, v in enumerate(good)]
    rows += [(100, None, 0), (101, [1.0, None, 2.0, 3.0], 0), (102, [1.0, float("nan"), 2.0, 3.0], 0),
             (103, [1.0, float("inf"), 2.0, 3.0], 0), (104, [], 0), (105, [1.0, 2.0], 0)]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got, list(range(50)), plain(good))


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert W.whitened(frame([])).collect() == []
    assert W.whitened(frame([(1, None, 0)])).collect() == []
    assert W.whitened(frame([(1, [0.5, 1.0], 0)] * 3)).collect() == []  # one distinct vector: no variance
    got = W.whitened(frame([(None, [0.0, 1.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 1)])).collect()
    assert sorted((r["vec_id"] is None, round(abs(r["whitened"]), 9), r["deviation"]) for r in got) == [(False, 1.0, 4096)] * 2 + [(True, 1.0, 4096)]
    wide = [(1, [1e9, 0.0], 0), (2, [-1e9, 0.0], 0), (3, [1e18, 0.0], 0)]
    got = W.whitened(frame(wide)).collect()
    assert [r["deviation"] for r in got] == [None, None]  # passes 64 bits
    extra = frame([(i, v, 0) for i, v in enumerate(table(9, 30, 3))]).selectExpr("*", "1 AS n", "2 AS component", "3 AS _x")
    assert len(W.whitened(extra).collect()) == 90


def test_one_vector_in_a_third_of_the_rows(spark):
    vectors = table(5, 200, 20)
    vectors += [vectors[7]] * 400
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    check(got, list(range(600)), plain(vectors))


def test_filter_is_a_chebyshev_polynomial():
    rng = np.random.default_rng(1)
    values = np.sort(rng.random(12))[::-1]
    q = np.eye(12)
    out = W._filtered(lambda x: values[:, None] * x, q, values[:, None] * q, float(values[5]), float(values[0]), 8)
    scaled = np.diag(out)
    assert np.allclose(out, np.diag(scaled)) and math.isclose(scaled[0], 1.0)
    at = (2 * values - values[5]) / values[5]
    cheb = np.polynomial.chebyshev.chebval(at, [0] * 8 + [1])
    np.testing.assert_allclose(scaled, cheb / cheb[0])
