"""Profiles against their definition, and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import langid
from leadloom.llm.common import fold, held_out

FOLDER = "/root/testdata/sf0.01"


def plain_vector(text, known):
    """The bundle of a text, trigram by trigram."""
    letters = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    letters = [c for i, c in enumerate(letters) if i == 0 or c or letters[i - 1]]
    out = np.zeros(known.dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        out += np.roll(known.vector(a).astype(int), 2) * np.roll(known.vector(b).astype(int), 1) * known.vector(c)
    return out


def test_bundles_are_sums_of_bound_trigrams(monkeypatch):
    known = langid.Letters(64, 5)
    texts = ["Hello, World", "", "a", "…", "l'été\n\nà  Zürich 2020", "x", "世界 한국", "end "]
    got = langid.bundles(*langid.trigrams(texts, known), len(texts), known)
    want = np.stack([plain_vector(t, known) if any(c.isalpha() for c in t) else np.zeros(64) for t in texts])
    assert (got == want).all()
    many = [chr(0x4E00 + i) * 3 + chr(0x4E00 + 7 * i) for i in range(300)]  # a large alphabet
    assert (langid.bundles(*langid.trigrams(many, known), len(many), known) == np.stack([plain_vector(t, known) for t in many])).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.predict(docs, fold(F.col("doc_id")) != 0, held_out(F.col("doc_id")))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    unseen = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert 150 < len(unseen) < 250 and np.mean(unseen) >= 0.97


def test_the_nearest_prototype_by_cosine(spark):
    """Languages, scores and familiarity against plain vectors, in one pass and in passes of two languages."""
    rng = np.random.default_rng(3)
    texts = ["the cat sat on the mat and the dog", "der Hund und die Katze auf dem Tisch", "le chat est sur la table", "", "12 34", "xyz", "Éte", "the chat und la table"]
    prototypes = {n: rng.integers(-50, 50, 256).astype(float) for n in ("de", "en", "fr", "it", "pt")}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = langid.Letters(256, langid.SEED)
    one = langid.identify(df, prototypes, dimensions=256, familiarity="means").collect()
    old, langid.GROUP = langid.GROUP, 2
    try:
        passes = langid.identify(df, prototypes, dimensions=256, familiarity="means")
        assert passes.columns == ["doc_id", "text", "lang_pred", "score", "means"]
        several = passes.collect()
    finally:
        langid.GROUP = old
    for rows in (one, several):
        for r in rows:
            if not any(c.isalpha() for c in r.text):
                assert (r.lang_pred, r.score, r.means) == ("und", 0.0, 0.0)
                continue
            vector = plain_vector(r.text, known)
            cosine = {n: float(vector @ p / (np.linalg.norm(vector) * np.linalg.norm(p))) for n, p in prototypes.items()}
            best = max(sorted(cosine), key=cosine.get)
            assert r.lang_pred == best and abs(r.score - max(0, cosine[best])) < 1e-9
            count = len(langid.trigrams([r.text], known)[0])
            assert abs(r.means - cosine[best] * np.linalg.norm(vector) / (16 * count)) < 1e-9


def test_as_many_languages_as_there_are(spark):
    """A language for every text: nothing is refused, and a text is found in its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(list(letters), 6)) for _ in range(12)), f"l{i:04d}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.learn(df, dimensions=1024)
    assert len(prototypes) == 300
    got = langid.identify(df, prototypes, dimensions=1024).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_odd_texts(spark):
    values = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "", None), (5, "123 -- !", "fr"),
              (None, "the dog", None), (1, "the cat sat on the mat", "en"), (6, "the " * 30_000, None)]
    df = spark.createDataFrame([(*v, "x", 1.0) for v in values], "doc_id long, text string, lang string, lang_pred string, score double")
    prototypes = langid.learn(df)
    assert sorted(prototypes) == ["en", "fr"]
    got = langid.identify(df, prototypes)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = sorted([(r.doc_id or 0, r.lang_pred, r.score) for r in got.collect()])
    assert [(i, p) for i, p, _ in rows] == [(0, "en"), (1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    assert all(s == 0 for i, p, s in rows if p == "und")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.learn(df) == {} and langid.learn(df.limit(0)) == {}
    assert [(r.lang_pred, r.score) for r in langid.identify(df, {}).collect()] == [("und", 0.0)] * 2
    assert langid.identify(df.limit(0), {}).count() == 0
