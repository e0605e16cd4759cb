"""The n-gram similarity join against brute force over all pairs of sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import ngram_join
from test_simhash import ROWS


def sets_of(rows, words):
    out = []
    for _, text in rows:
        own = (text or "").encode().lower().split()
        out.append(frozenset(b" ".join(own[k:k + words]) for k in range(max(1, len(own) - words + 1))) if own else frozenset())
    return out


def plain_components(rows, words, p, q):
    """Per row the smallest id reachable over links of all pairs of texts; every row has an id."""
    sets = sets_of(rows, words)
    first = {}
    for (i, _), own in zip(rows, sets):
        first[own] = min(i, first.get(own, i))
    keys = sorted(first, key=first.get)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for j, one in enumerate(keys):
        for other in keys[:j]:
            if one and other and q * len(one & other) >= p * len(one | other) and find(one) != find(other):
                a, b = sorted((find(one), find(other)), key=first.get)
                root[b] = a
    return sorted((i, len(own), first[find(own)] if own else i) for (i, _), own in zip(rows, sets))


def variants(seed, count=400):
    """Texts of 1 to 400 words with chains of copies in which a few words differ, on both sides of the limit, and one common passage."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    while len(rows) < count:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 5, 8, 9, 12, 30, 100, 400]))]
        if len(words) > 20 and rng.random() < 0.5:
            words[10:10] = passage
        for _ in range(rng.choice([1, 1, 2, 4, 20])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, max(1, len(words) // 50), max(1, len(words) // 30)])):
                words[rng.choice([0, -1, rng.randrange(len(words))])] = f"x{rng.randrange(5000)}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,part_nodes,part_bytes", [(1, 4096, 1 << 24), (2, 3, 1 << 12)])
def test_against_brute_force(spark, monkeypatch, seed, part_nodes, part_bytes):
    monkeypatch.setattr(ngram_join, "PART_NODES", part_nodes)
    monkeypatch.setattr(ngram_join, "PART_BYTES", part_bytes)
    rows = variants(seed)
    rows += rows[:10] + [(1000 + i, "same text of some words here") for i in range(50)] + [(2000, None), (2001, " "), (2002, "")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 4, 85, 100)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ngram_join.near_duplicates(docs).collect()
    want = plain_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 4, 85, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


@pytest.mark.parametrize("p,q", [(85, 100), (4, 5), (1, 2)])
def test_linked_sets_share_a_tile(p, q):
    rng = np.random.default_rng(p)
    for _ in range(3000):
        size = int(rng.choice([1, 2, 5, 6, 10, 17, 40, 150, 900]))
        one = np.unique(rng.integers(0, 1 << 64, size, np.uint64, endpoint=False))
        kept = one[rng.random(len(one)) >= rng.choice([0, 0.02, 0.1])]
        other = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, int(rng.integers(0, 1 + size // 6)), np.uint64)]))
        common = ngram_join.overlap(one, other)
        assert common == len(np.intersect1d(one, other))
        if len(other) and q * common >= p * (len(one) + len(other) - common) and common < max(len(one), len(other)):
            assert len(np.intersect1d(ngram_join.tiles_of(one, p, q), ngram_join.tiles_of(other, p, q)))


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(300):
        one, other = (np.unique(rng.integers(0, 700, int(rng.integers(1, 600)), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        words = ngram_join.folded([ngram_join.bitmap(one), ngram_join.bitmap(other)])
        differ = int(np.bitwise_count(words[0] ^ words[1]).sum())
        assert 2 * ngram_join.overlap(one, other) <= len(one) + len(other) - differ


def test_a_dense_family_makes_no_pairs(spark, monkeypatch):
    """3,000 near copies: rows made stay in proportion to them."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    made = []
    whole = ngram_join.settle
    monkeypatch.setattr(ngram_join, "settle", lambda *a: made.append(whole(*a)) or made[-1])
    got = ngram_join.near_duplicates(df).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]
    assert made[0].count() < 200 * len(rows) and made[1].count() < 2 * len(rows)


def test_keep_first_and_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in ROWS], "doc_id long, text string, node string, grp int, __id int, __hash int")
    rows = ngram_join.keep_first(df, words=5, similar=(4, 5)).collect()
    assert rows[0].__fields__ == df.columns
    assert sorted(r.doc_id or -1 for r in rows) == [-1, 1, 2, 3, 8, 8, 100]
    assert ngram_join.keep_first(df.limit(0)).count() == ngram_join.near_duplicates(df.limit(0)).count() == 0
    assert ngram_join.keep_first(df.where(F.col("text").isNull())).count() == 1
    assert ngram_join.near_duplicates(df).count() == len(ROWS)


def plain_kept(rows):
    """Smallest id of each component of five-word similarity of at least 4/5; texts without words are copies of one another."""
    found = plain_components(rows, 5, 4, 5)
    blank = [i for i, size, _ in found if not size]
    return sorted({c for _, size, c in found if size} | set(blank[:1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_against_brute_force(spark, seed):
    rows = variants(seed)
    rows += rows[:10] + [(1000, "same text of some words here")] * 50 + [(2000, None), (2001, " ")]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == plain_kept(rows)


def test_stage_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want
