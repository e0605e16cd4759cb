"""Weights against a plain bisection, and the draw against a sequential one."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from leadloom.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, weight string, copies int")


def rows_of(sizes):
    out = []
    for name, n in sizes.items():
        out += [(len(out) + i, name, "word " * (1 + (i * 7) % 23)) for i in range(n)]
    return out


def plain_exponent(held, budget, entropy, max_repeats):
    total = sum(held)
    shares = [h / total for h in held]

    def weights(t):
        z = sum(s ** t for s in shares)
        return [s ** t / z for s in shares]

    def bisect(fine):
        low, high = 0.0, 1.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if fine(middle) else (low, middle)
        return low

    target = entropy * math.log(len(held))
    flat = 1.0 if -sum(p * math.log(p) for p in weights(1)) >= target else bisect(lambda t: -sum(p * math.log(p) for p in weights(t)) >= target)
    repeats = lambda t: max(budget * p / h for p, h in zip(weights(t), held))
    rare = 0.0 if repeats(0) <= max_repeats else bisect(lambda t: repeats(t) > max_repeats)
    return max(flat, rare), weights(max(flat, rare))


@pytest.mark.parametrize("entropy, max_repeats", [(0.95, 4.0), (1.0, 2.0), (0.5, 4.0), (0.9, 1.5)])
def test_weights(spark, entropy, max_repeats):
    rows = rows_of({"big": 400, "mid": 60, "small": 15, None: 30})
    got = mixing.mix(frame(spark, rows), entropy=entropy, max_repeats=max_repeats).collect()
    held = {}
    for _, s, t in rows:
        held[s] = held.get(s, 0) + len(t.split())
    _, want = plain_exponent(list(held.values()), sum(held.values()), entropy, max_repeats)
    for name, weight in zip(held, want):
        own = [r for r in got if r.source == name]
        assert all(abs(r.weight - weight) < 1e-5 for r in own)
        drawn, longest = sum(r.copies * r.n_tokens for r in own), max(r.n_tokens for r in own)
        budget = weight * sum(held.values())
        assert abs(drawn - budget) <= longest / 2 + 1
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


def test_the_draw_follows_the_permuted_blocks(spark):
    rows = rows_of({"a": 200, "b": 30})
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows), block_docs=16).collect()}
    md5 = lambda *x: hashlib.md5(":".join(map(str, (6, *x))).encode()).hexdigest()
    for name in "ab":
        own = [(i, len(t.split())) for i, s, t in rows if s == name]
        blocks = -(-len(own) // 16)
        place = lambda x: (md5(name, "block", int(md5(name, x[0])[:8], 16) % blocks), md5(name, x[0]))  # noqa: B023, E731
        before, held = 0, sum(n for _, n in own)
        budget = round(got[own[0][0]].weight * sum(len(t.split()) for _, _, t in rows))
        for i, n in sorted(own, key=place):
            assert got[i].tokens_before == before
            assert got[i].copies == budget // held + (before + n / 2 <= budget % held)
            before += n


def test_a_source_of_one_document_stays(spark):
    """Its weight pays for more than half of it, so it is taken; a budget of less than half leaves it out."""
    rows = [(i, "many", "word " * 100) for i in range(95)] + [(1000, "one", "word " * 4000)]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    total = 95 * 100 + 4000
    assert 0.5 < got[1000].weight * total / 4000 and got[1000].copies == round(got[1000].weight * total / 4000)
    less = {r.doc_id: r for r in mixing.mix(frame(spark, rows), budget=total // 4).collect()}
    assert less[1000].copies == (less[1000].weight * (total // 4) >= 2000)


def test_names_of_its_own(spark):
    """Columns with the names that the operator uses inside keep their values."""
    names = ["__source", "__id", "__hash", "__copy", "__source_of", "__block", "__mark", "weight", "n_tokens"]
    df = frame(spark, rows_of({"a": 40, "b": 5})).drop("weight", "copies")
    clashing = df.withColumns({n: F.lit(n) for n in names})
    got = mixing.realised(clashing)
    assert got.columns == clashing.columns and got.count() == mixing.realised(df).count()
    assert all(r[n] == n for r in got.collect() for n in names)


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, "one two"), (None, "a", "x y"), (4, "a", "w " * 50_000), (5, "a", "same"), (5, "a", "same"), (6, "empty", " ")]
    df = mixing.mix(frame(spark, rows))
    assert df.columns == ["doc_id", "source", "text", "n_tokens", "weight", "tokens_before", "copies"]
    got = df.collect()
    assert len(got) == len(rows)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 6)} == {0} and {r.weight for r in got if r.source == "empty"} == {0.0}
    assert len({r.copies for r in got if r.doc_id == 5}) == 1
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, "a", " ")])).first().copies == 1


def test_realised(spark):
    df = frame(spark, rows_of({"a": 100, "b": 5}))
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = mixing.realised(df)
    assert got.columns == df.columns
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}


def test_one_seed_one_draw_and_no_python(spark):
    df = frame(spark, rows_of({"a": 300, "b": 40}))
    one = sorted(map(tuple, mixing.mix(df).select("doc_id", "copies").collect()))
    assert one == sorted(map(tuple, mixing.mix(df.repartition(7, F.col("doc_id"))).select("doc_id", "copies").collect()))
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
