"""Fingerprints, links and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from leadloom.llm import simhash


def plain_fingerprint(text, words=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    """fingerprint -> the set of all reachable ones, by all pairs"""
    prints, of = sorted(set(prints)), {}
    for p in prints:
        if p in of:
            continue
        of[p], todo = {p}, [p]
        while todo:
            a = todo.pop()
            for b in prints:
                if b not in of[p] and (a ^ b).bit_count() <= distance:
                    of[p].add(b)
                    todo.append(b)
        for q in of[p]:
            of[q] = of[p]
    return of


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b c d", "ÀB ç d\x0be f\x1cg", "x " * 500, "dup dup dup dup dup dup"])
def test_fingerprints(text):
    assert int(simhash.fingerprints([text, "other words stand here"])[0]) == plain_fingerprint(text)


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def clusters(seed, n):
    """Fingerprints with chains of near ones, some just out of reach."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 15, 31}
    while len(out) < n:
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            out.add(value)
            value = flipped(rng, value, rng.choice([1, 2, 4, 5]))
    return sorted(out)


@pytest.mark.parametrize("prefix", [0, 13])
def test_trie_pairs(monkeypatch, prefix):
    monkeypatch.setattr(simhash, "DIRECT", 4)
    monkeypatch.setattr(simhash, "STEP", 16)
    keys = np.sort(np.array(clusters(prefix, 300), np.uint64))
    top = keys >> np.uint64(64 - prefix) if prefix else np.zeros(len(keys), np.uint64)
    edges = np.flatnonzero(np.r_[True, top[1:] != top[:-1], True])
    pairs = [(a, b, a, b, prefix, 0) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    got = sorted(tuple(sorted(x)) for left, right in simhash.trie_pairs(keys, pairs, 4) for x in zip(left.tolist(), right.tolist()))
    want = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys))
            if top[i] == top[j] and (int(keys[i]) ^ int(keys[j])).bit_count() <= 4]
    assert got == want and want


@pytest.mark.parametrize("group", [1 << 16, 4])
def test_components_of_links(spark, monkeypatch, group):
    """With groups that are split by further bits, too: more than a thousand fingerprints share a block's value."""
    monkeypatch.setattr(simhash, "GROUP", group)
    prints = clusters(9, 1200)
    if group == 4:
        prints = sorted({p & ~(0xFFF << 52) for p in prints[:600]} | set(prints[600:]))
    want = plain_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "node long, fingerprint long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    for i, p in enumerate(prints):
        others = {prints.index(q) for q in want[p]}
        assert got.get(i, i) == min(others)


def test_a_dense_family_is_a_forest():
    """4,000 fingerprints within four bits of one another or nearly so: far fewer pairs are looked at than there are."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    family = sorted({flipped(rng, base, rng.choice([1, 2])) for _ in range(4000)})
    keys, seen = np.array(family, np.uint64), []
    whole = simhash._compare
    simhash._compare = lambda keys, pairs, distance: seen.append(int(((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])).sum())) or whole(keys, pairs, distance)
    try:
        left, right = simhash.connected(keys, [(0, len(keys), 0, len(keys), 0, 0)], 4)
    finally:
        simhash._compare = whole
    assert len(left) == len(keys) - 1 and set(right.tolist()) == {0}
    assert sum(seen) < len(keys) ** 2 / 4


def test_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(500)] + [(5, 5), (200, 199)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(501)}


BASE = " ".join(f"word{i * 7919 % 997}" for i in range(400))
ROWS = [(5, BASE), (3, BASE), (9, BASE.replace("word5 ", "changed ")), (7, None), (4, ""), (2, "   "), (8, "short"), (8, "short"), (8, "another text"),
        (None, BASE), (None, "no id at all, and no copy"), (1, "x" * 50_000)] + [(100 + i, "a text that a third of all rows share " * 3) for i in range(30)]


def test_documents(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, component string")).collect()
    of = plain_components([plain_fingerprint(t) for _, t in ROWS])
    want = []
    for i, t in ROWS:
        p = plain_fingerprint(t)
        ids = [j for j, u in ROWS if plain_fingerprint(u) in of[p] and j is not None]
        want.append((i, f"{p:016x}", min(ids, default=None)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert {r.component_id for r in got if r.doc_id in (3, 5, 9)} == {3}


def test_one_document_of_each_component_stays(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, fingerprint string, component int")
    rows = simhash.keep_first(df).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "fingerprint", "component"]
    assert sorted((r.doc_id or -1 for r in rows)) == [-1, 1, 2, 3, 8, 8, 100] and len({r.text for r in rows}) == 7
    assert simhash.keep_first(df.limit(0)).count() == 0
