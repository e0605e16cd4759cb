"""Both classifiers: held-out accuracy, what they can learn, odd input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import hashed, quality, toxicity
from leadloom.llm.common import fold

FOLDER = "/root/testdata/sf0.1"


def learning(doc_id):
    return fold(doc_id) != 0


@pytest.mark.parametrize("operator, label, caught, spared", [(quality, "quality", 0.95, 0.95), (toxicity, "toxic", 0.75, 0.98)])
def test_held_out(spark, operator, label, caught, spared):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = operator.train(docs, labels, learning)
    rows = operator.score(docs.join(labels, "doc_id").where(~learning(F.col("doc_id"))).select("doc_id", "text", label), model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) > 500
    bad = 0 if label == "quality" else 1
    hit = [(r.score >= operator.THRESHOLD) == (r[label] == 1) for r in rows if r[label] == bad]
    clean = [(r.score >= operator.THRESHOLD) == (r[label] == 1) for r in rows if r[label] != bad]
    assert np.mean(hit) >= caught and np.mean(clean) >= spared


def test_a_machine_learns_what_weights_cannot(spark):
    """Label 1 where an insult and a group meet; either alone is harmless."""
    rng, rows = random.Random(3), []
    filler = [f"filler{i}" for i in range(60)]
    for i in range(2400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(filler, 12) + ["oaf"] * insult + ["clan"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), float(insult and group), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, label double, slice int")
    model = toxicity.learn(df, rounds=12)
    got = toxicity.score(df, model).collect()
    assert np.mean([(r.score >= 0.5) == (r.label == 1) for r in got]) >= 0.97
    place = lambda w: np.frombuffer(toxicity.Terms().raw(w), "<i4")[0]
    vectors = {w: model.vectors[place(w)] for w in ("oaf", "clan")}
    assert vectors["oaf"] @ vectors["clan"] > 0


def test_the_sample_is_bounded_and_outside_the_fold(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = hashed.sample(docs, labels, "quality", learning, rows=100).select("doc_id", "slice").collect()
    assert len(rows) == 100 and {r.slice for r in rows} <= set(range(hashed.SLICES))
    import zlib
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_conflicting_labels_follow_the_majority(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(1, "text again"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = hashed.sample(docs, labels, "quality", lambda c: c.isNotNull()).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 0.0), (2, 1.0)]


def test_one_row_an_id(spark):
    """An id with a third of all rows, in different texts, teaches one of them: the same one however rows lie."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "a") for i in range(2, 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 1000)], "doc_id long, quality int")
    one, other = (hashed.sample(d, labels, "quality", lambda c: c.isNotNull(), rows=50_000).collect() for d in (docs.repartition(3), docs.repartition(11)))
    assert len(one) == 999 and sorted(one) == sorted(other)


def plain_sigmoid(x):
    return 1 / (1 + math.exp(-min(35, max(-35, x))))


def test_machine_is_the_sum_over_pairs():
    rng = random.Random(4)
    for _ in range(20):
        n = rng.randrange(1, 9)
        w, x = [rng.gauss(0, 1) for _ in range(n)], [rng.random() for _ in range(n)]
        v = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(n)]
        want = 0.3 + sum(a * b for a, b in zip(w, x))
        want += sum(sum(a * b for a, b in zip(v[i], v[j])) * x[i] * x[j] for i in range(n) for j in range(i))
        assert abs(toxicity.machine(0.3, np.array(w), np.array(v), np.array(x)) - want) < 1e-12


def test_batches_score_like_single_texts():
    rng = np.random.default_rng(5)
    model = toxicity.Model(-0.2, rng.random(toxicity.PLACES), rng.standard_normal(toxicity.PLACES), rng.standard_normal((toxicity.PLACES, 4)))
    at = [np.unique(rng.integers(0, toxicity.PLACES, k)) for k in (3, 0, 50, 1)]
    got = model.values_of(np.repeat(range(4), [len(x) for x in at]), np.concatenate(at).astype(int), 4)
    assert np.allclose(got, [model.value(x.astype(int)) for x in at])


def test_one_epoch_of_the_machine():
    """Against plain loops over dictionaries."""
    rng = np.random.default_rng(6)
    size, rows = 12, []
    for _ in range(40):
        at = np.sort(rng.choice(size, rng.integers(1, 6), replace=False)).astype("<i4")
        rows.append((at, float(rng.random() < 0.4)))
    idf = 0.1 + rng.random(size)
    state = {"z": np.zeros(size + 1), "n": np.zeros(size + 1), "v": rng.normal(0, 0.1, (size, 2)), "g": np.ones((size, 2))}
    got = toxicity.epoch(rows, idf, state)
    z, n, v, g = ([0.0] * (size + 1), [0.0] * (size + 1), state["v"].tolist(), state["g"].tolist())

    def weight(i, l1, l2):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    for at, label in rows:
        at = at.tolist()
        norm = toxicity.LENGTH / math.sqrt(sum(idf[i] ** 2 for i in at))
        x = {i: idf[i] * norm for i in at}
        w = {i: weight(i, toxicity.L1, toxicity.L2) for i in at}
        bias = weight(size, 0.0, 0.0)
        own = {i: list(v[i]) for i in at}
        value = bias + sum(w[i] * x[i] for i in at) + sum(sum(a * b for a, b in zip(own[i], own[j])) * x[i] * x[j] for i in at for j in at if i < j)
        error = (plain_sigmoid(value) - label) * (toxicity.POSITIVE if label else 1.0)
        for i in at:
            for f in range(2):
                slope = error * x[i] * sum(own[j][f] * x[j] for j in at if j != i) + toxicity.SHRINK * own[i][f]
                g[i][f] += slope * slope
                v[i][f] = own[i][f] - toxicity.RATE * slope / math.sqrt(g[i][f])
            slope = error * x[i]
            z[i] += slope - (math.sqrt(n[i] + slope * slope) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
            n[i] += slope * slope
        z[size] += error - (math.sqrt(n[size] + error * error) - math.sqrt(n[size])) / toxicity.ALPHA * bias
        n[size] += error * error
    for name, want in zip("znvg", (z, n, v, g)):
        assert np.allclose(got[name], want), name


def test_one_epoch_of_the_leader():
    """FTRL-Proximal against plain loops, and the score as a plain dot product."""
    rng = np.random.default_rng(7)
    rows = [(np.sort(rng.choice(20, 4, replace=False)), rng.random(4), float(rng.random() < 0.5)) for _ in range(50)]
    got_z, got_n = quality.epoch(rows, np.zeros(21), np.zeros(21))
    z, n = [0.0] * 21, [0.0] * 21
    for at, values, label in rows:
        x = dict(zip([*at.tolist(), 20], [*values.tolist(), 1.0]))
        w = {i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2) for i in x}
        error = plain_sigmoid(sum(w[i] * x[i] for i in x)) - label
        for i in x:
            slope = error * x[i]
            z[i] += slope - (math.sqrt(n[i] + slope * slope) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += slope * slope
    assert np.allclose(got_z, z) and np.allclose(got_n, n)


def test_quality_scores_are_dot_products(spark):
    model = np.random.default_rng(8).standard_normal((1 << quality.BITS) + 1)
    texts = ["one two two two.", "", "a b c " * 50]
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        places = quality.ngrams(hashed.Tokens()(r.text)).tolist()
        want = model[-1] + (quality.SCALE * sum(model[i] for i in places) / len(places) if places else 0.0)
        assert abs(r.score - plain_sigmoid(want)) < 1e-9


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_texts_and_no_labels(spark, operator):
    docs = spark.createDataFrame([(1, None, 7.0), (2, "", 7.0), (3, "  ", 7.0), (None, "words", 7.0), (5, "w " * 100_000, 7.0), (5, "w", 7.0)],
                                 "doc_id long, text string, score double")
    model = operator.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), learning)
    got = operator.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and [r.score for r in got.collect()] == [0.5] * 6
    assert operator.score(docs.limit(0), model).count() == 0


def test_ngrams():
    tokens = hashed.Tokens()
    a, b = quality.ngrams(tokens("one two one")), quality.ngrams(tokens("one  two\none"))
    assert a.tolist() == b.tolist() and len(a) == 5
    assert len(set(quality.ngrams(tokens("again again again again")).tolist())) == 4  # word, mark, word + mark, mark + mark
    assert quality.ngrams(tokens("")).tolist() == []
