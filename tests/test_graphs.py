"""Components against a plain search: chains, stars, dense and random graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom import graphs


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def got(spark, edges, parts=7):
    rows = graphs.components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("chunk", [5, 1 << 19])
def test_random_graphs(spark, monkeypatch, chunk):
    monkeypatch.setattr(graphs, "CHUNK", chunk)
    rng = random.Random(chunk)
    for n, m in ((30, 15), (400, 300), (400, 900)):
        edges = [(a, b) for a, b in ((rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)) if a != b]
        assert got(spark, edges + edges[:5]) == plain(edges)


@pytest.mark.parametrize("chunk", [8, 1 << 19])
def test_chains_and_stars(spark, monkeypatch, chunk):
    """A chain whose nodes are numbered at random, and one in order: rounds grow with the logarithm, as the limit shows."""
    monkeypatch.setattr(graphs, "CHUNK", chunk)
    names = list(range(3000))
    random.Random(1).shuffle(names)
    chain = list(zip(names, names[1:]))
    df = spark.createDataFrame(chain, "a long, b long").repartition(16)
    assert graphs.components(df, rounds=20).agg(F.max("component"), F.count("node")).first()[:] == (0, 3000)
    ordered = spark.range(1, 3000).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).repartition(16)
    assert graphs.components(ordered, rounds=20).agg(F.max("component"), F.count("node")).first()[:] == (0, 3000)
    star = [(5000, i) for i in range(100, 2000)] + [(i, 1) for i in range(3000, 4000)]
    assert got(spark, star) == plain(star)


def test_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graphs.components(none).count() == 0
    assert graphs.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_contracted():
    a, b = graphs.contracted(np.array([5, 9, 7, 20]), np.array([9, 2, 8, 21]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 2, 9: 2, 8: 7, 21: 20}
