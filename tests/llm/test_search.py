"""Both searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import exact_search, hash_forest, tiles


def query():
    return F.col("vec_id") % 50 == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label string, score double")


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, v) for i, v in enumerate(rng.standard_normal((n, dim)).astype(np.float32).tolist())]


def fine(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def brute(rows, score, k=5, zero_too=True):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and fine(v)]
    rows = [(i, v) for i, v in rows if zero_too or v.any()]
    out = {}
    for q, a in rows:
        if q % 50 == 0:
            found = {(-score(a, b), i) for i, b in rows if i != q and len(b) == len(a)}
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def integer(a, b):
    return int((np.floor(256 * a).astype(object) * np.floor(256 * b).astype(object)).sum())


def cosine(a, b):
    return round(float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), 12)


ODD = [(None, [1.0] * 16), (1000, None), (1001, []), (1050, [float("nan")] * 16), (1002, [1.0] * 15 + [None]), (1003, [float("inf")] * 16),
       (1100, [0.0] * 16), (1150, [1.0, 2.0]), (1004, [2.0, 1.0]), (1005, [0.5] * 16), (1005, [0.25, -0.5] * 8), (0, None)]


@pytest.mark.parametrize("shard_rows", [64, 100_000])
def test_exact_search(spark, shard_rows):
    rows = vectors(400) + ODD
    rows += [(2000 + i, [0.5] * 16) for i in range(300)] + [rows[3], rows[50]]  # a hot vector, repeated rows
    got = listed(exact_search.search(frame(spark, rows), query(), shard_rows=shard_rows, block_rows=3))
    assert got == brute(rows, integer)


def test_exact_search_beyond_doubles(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((np.array(vectors(60, 4)[j][1]) * 1e6).tolist() for j in range(60))]
    assert listed(exact_search.search(frame(spark, rows), query())) == brute(rows, integer)


def test_forest_of_tiny_shards(spark):
    """Where the floor gathers nearly all rows, hardly anything is missed, and what is found has the right scores and ranks."""
    rows = vectors(400) + ODD + [(2000 + i, [0.5] * 16) for i in range(300)]
    got = listed(hash_forest.search(frame(spark, rows), query(), shard_rows=200))
    want = brute(rows, cosine, zero_too=False)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    every = brute(rows, cosine, k=10_000, zero_too=False)
    for q in got:
        assert all(any(i == j and abs(s - t) < 1e-9 for j, t in every[q]) for i, s in got[q])  # an id may have several vectors
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert recall(got, want) >= 0.95


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_forest_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + 1.5 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(6000)]
    got, want = listed(hash_forest.search(frame(spark, rows), query(), shard_rows=2500)), brute(rows, cosine, zero_too=False)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_forest_recall_on_given_tables(spark, folder):
    """Production settings."""
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], cosine, zero_too=False)
    assert recall(listed(hash_forest.search(df, query())), want) >= 0.92


def test_forest_recall_on_isotropic_vectors(spark):
    """The worst case, production settings, more rows than the floor decides."""
    rows = vectors(12_000, 64, seed=9)
    assert recall(listed(hash_forest.search(frame(spark, rows), query())), brute(rows, cosine, zero_too=False)) >= 0.92


def test_a_query_ascends_to_the_longest_shared_prefixes():
    rng = np.random.default_rng(5)
    strings = [np.sort(rng.integers(0, 1 << 12, 500).astype(np.uint64)) for _ in range(3)]
    shard = hash_forest.Shard(np.arange(500), np.ones((500, 2)), np.stack(strings), np.tile(np.arange(500), (3, 1)), 12)
    asked = rng.integers(0, 1 << 12, (3, 20)).astype(np.uint64)
    low, high = shard.below(asked, 40)
    for q in range(20):
        for dropped in range(13):
            ranges = [np.flatnonzero(s >> np.uint64(dropped) == asked[t, q] >> np.uint64(dropped)) for t, s in enumerate(strings)]
            if sum(map(len, ranges)) >= 40:
                break
        assert [h - a for a, h in zip(low[:, q], high[:, q])] == [len(r) for r in ranges]


@pytest.mark.parametrize("search", [exact_search.search, hash_forest.search])
def test_nothing_to_search(spark, search):
    assert search(frame(spark, [(1, None)]), query()).count() == 0
    assert search(frame(spark, [(0, [1.0, 0.5])]), query()).count() == 0


@pytest.mark.parametrize("search", [exact_search.search, hash_forest.search])
def test_nothing_packed_travels(spark, search):
    """A block of queries as bytes, a thousand copies of it at once, filled an executor's heap, and so did a shard's forest beside every block."""
    plan = search(frame(spark, vectors(400)), query(), shard_rows=64, block_rows=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not any(word in plan for word in ("Join", "matrix", "strings"))


@pytest.mark.parametrize("slots, strip_rows", [(1, 3), (3, 5), (64, 65536)])
def test_strips_and_slots(spark, monkeypatch, slots, strip_rows):
    """Tasks with several shards and queries in several strips find the same."""
    rows = vectors(400) + ODD + [(2000 + i, [0.5] * 16) for i in range(300)]
    whole = listed(hash_forest.search(frame(spark, rows), query(), shard_rows=64))
    monkeypatch.setattr(tiles, "LEAST_SLOTS", slots)
    monkeypatch.setattr(tiles, "STRIP_ROWS", strip_rows)
    assert listed(exact_search.search(frame(spark, rows), query(), shard_rows=64, block_rows=2)) == brute(rows, integer)
    assert listed(hash_forest.search(frame(spark, rows), query(), shard_rows=64, block_rows=2)) == whole


def test_a_tile_gives_all_that_reaches_the_best_so_far():
    """Whatever the order of shards, with equal scores, equal ids and doubles left behind."""
    rng = np.random.default_rng(8)
    for scale in (3, 1e8):
        matrix = np.floor(rng.integers(-3, 4, (900, 4)) * scale)
        ids = np.sort(rng.integers(0, 800, 900))
        strip = exact_search.Strip(np.arange(0, 800, 50), matrix[:16], 5, 6)
        for start in range(0, 900, 300):
            strip.add(ids[start:start + 300], matrix[start:start + 300])
        got = list(zip(*(x.tolist() for x in strip.lists())))
        want = [(q, i, s) for q, v in zip(range(0, 800, 50), matrix[:16])
                for s, i in sorted(((int(sum(int(a) * int(b) for a, b in zip(v, row))), i) for i, row in zip(ids.tolist(), matrix) if i != q), key=lambda x: (-x[0], x[1]))[:5]]
        assert got == want
