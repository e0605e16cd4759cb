"""Whitening against plain numpy and exact integers."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import whitening


def orthogonal(size, rng):
    return np.linalg.qr(rng.standard_normal((size, size)))[0]


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 40), 10.0 ** np.linspace(-6, 3, 30), np.r_[1, 1 + 1e-9, 1 + 2e-9, 2, 2 + 1e-12, 3, np.linspace(4, 5, 20)],
    np.r_[np.ones(6), 2 * np.ones(3), 3.0], np.r_[np.zeros(4), np.linspace(1, 2, 6)], [5.0],
])
def test_refined(values):
    rng = np.random.default_rng(1)
    values = np.sort(np.asarray(values, float))[::-1]
    basis = orthogonal(len(values), rng).astype(np.longdouble)
    exact = (basis * values) @ basis.T
    exact = (exact + exact.T) / 2
    high = exact.astype(float)
    found, vectors = whitening.refined(high, (exact - high).astype(float))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14
    assert np.abs(found - values).max() < 1e-13 * values[0]
    # residuals far below those of the float32 start, also within clusters
    wide = vectors.astype(np.longdouble)
    assert np.abs(exact @ wide - wide * found).max() < 3e-15 * values[0]


def test_clusters_are_told_apart():
    """Vectors of eigenvalues 1e-9 apart, which float32 mixes, are right to many digits."""
    rng = np.random.default_rng(2)
    values = np.r_[3 + 2e-9, 3 + 1e-9, 3, np.linspace(1, 2, 12)[::-1]]
    wide = np.eye(15, dtype=np.longdouble)
    for _ in range(30):  # rotations in extended precision
        i, j = rng.choice(15, 2, replace=False)
        angle = np.longdouble(rng.uniform(0, 3))
        turn = np.eye(15, dtype=np.longdouble)
        turn[i, i] = turn[j, j] = np.cos(angle)
        turn[i, j], turn[j, i] = np.sin(angle), -np.sin(angle)
        wide = wide @ turn
    exact = (wide * values) @ wide.T
    high = exact.astype(float)
    _, vectors = whitening.refined(high, (exact - high).astype(float))
    assert np.abs(np.abs((wide.T @ vectors).astype(float)) - np.eye(15)).max() < 1e-8


def test_exact_sums():
    rng = np.random.default_rng(3)
    for top in (1 << 10, 1 << 30, 1 << 60):
        z = rng.integers(-top, top, (50, 5))
        want = z.astype(object).T @ z.astype(object)
        assert (whitening.exact_products(z) == want).all() and (whitening.exact_sums(z) == z.astype(object).sum(0)).all()


def plain(vectors, components=8):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    away = (x - sums / n)
    values, found = np.linalg.eigh(away.T @ away / n)
    order = np.argsort(-values)[:components]
    return n, ((n * x - sums).astype(object) ** 2).sum(1), away @ found[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = whitening.whiten(df).collect()
    given = df.orderBy("vec_id").collect()
    n, deviation, white, explained = plain([r.embedding for r in given])
    at = {r.vec_id: i for i, r in enumerate(given)}
    assert len(rows) == 8 * n
    signs = {}
    for r in rows:
        want = white[at[r.vec_id], r.component - 1]
        sign = signs.setdefault(r.component, np.sign(want * r.whitened) if abs(want) > 0.1 else 0) or np.sign(want * r.whitened)
        assert abs(sign * r.whitened - want) < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-10
        assert r.deviation == deviation[at[r.vec_id]] and r.n == n and r.identity_error < 1e-10


ODD = [(1, [1.0, 2.0, 0.5]), (2, [2.0, 1.0, -0.25]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 0.0, 0.0]), (7, []),
       (8, [3.0, 3.0, 3.0]), (8, [3.0, 3.0, 3.0]), (None, [0.0, 0.0, 1.0]), (9, [1.0, 2.0]), (10, [2.0, 5.0]), (11, [7.0]), (12, [1e300, 0.0, 0.0])]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in ODD], "vec_id long, embedding array<double>, whitened string, length int")
    rows = whitening.whiten(df).collect()
    three = [v for i, v in ODD if v and len(v) == 3 and None not in v and np.isfinite(v).all() and max(v) < 1e100]
    n, deviation, white, explained = plain(three)
    own = [r for r in rows if r.n == 5]
    assert n == 5 and len(own) == 5 * 3 and {r.component for r in own} == {1, 2, 3}
    assert sorted(r.deviation for r in own if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in own if r.component == 1), sorted(abs(white[:, 0])))
    assert {r.vec_id for r in rows if r.n == 2} == {9, 10}  # one component of two vectors; the lone vector of length one has no variance
    assert all(r.component == 1 and abs(abs(r.whitened) - 1) < 1e-12 for r in rows if r.n == 2)
    assert not [r for r in rows if r.vec_id == 11] and all(r.identity_error < 1e-10 for r in rows)
    kept = whitening.transform(df, whitening.fit(df))
    assert kept.columns == ["vec_id", "embedding", "length", "whitened", "deviation"] and kept.count() == len(ODD)


def test_empty_and_constant(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], kind)).count() == 0


def test_large_entries(spark):
    df = spark.createDataFrame([(i, [1e12 * i, 3.0 * i * i, 7.0]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert {r.component for r in rows} == {1} and all(r.deviation is None for r in rows if r.vec_id in (0, 5))
    exact = [Fraction(int(1024e12 * i)) for i in range(6)]
    mean = sum(exact) / 6
    scale = float(sum((e - mean) ** 2 for e in exact) / 6) ** 0.5
    assert np.allclose(sorted(r.whitened for r in rows), sorted(float(e - mean) / scale for e in exact))
