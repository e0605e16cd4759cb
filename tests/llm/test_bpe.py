"""Tree concatenation against the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "''ll", "é", "é", "̧̂", "1", "23", "%%", "<|endoftext|>", "<|end", "世界",
         "한", "한", "ß", "İ", "…", "don't", "we're", "x" * 30, "===", " ", "\x1c", "\x85", " ", "🙂", "م", "ொ", "Σ", "ς"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        if k % 3:
            yield "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 400)))
        else:  # unsplit
            yield "".join(rng.choice("abcdehtsin") for _ in range(rng.randrange(0, 1500)))


@pytest.mark.parametrize("window", [2, 9, 64])
def test_joined_halves_equal_the_whole(library, monkeypatch, window):
    monkeypatch.setattr(bpe, "FIRST_WINDOW", window)
    codec, rng = bpe.Codec(PATH), random.Random(window)
    joins = 0
    for text in texts(window, 500):
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.ids(text).tolist() == want
        leaves = bpe.halves(text, rng.choice([8, 20, 50]), codec.special)
        assert "".join(x for _, x in leaves) == text
        joins += len(leaves) > 1
        assert bpe.join_tree(codec, {path: (x, codec.ids(x)) for path, x in leaves}).tolist() == want
        assert codec.decode(np.array(want, "<u4").tobytes()).decode() == library.decode(want, skip_special_tokens=False)
    assert joins > 300


def test_a_join_encodes_only_around_itself(monkeypatch):
    codec, seen = bpe.Codec(PATH), []
    text = "".join(random.Random(1).choice("abcdehtsin") for _ in range(20_000))
    (_, a), (_, b) = bpe.halves(text, 10_000, codec.special)
    of_a, of_b = codec.ids(a), codec.ids(b)
    plain = codec.ids
    monkeypatch.setattr(codec, "ids", lambda x: seen.append(len(x)) or plain(x))
    joined = bpe.join(codec, (a, of_a), (b, of_b))[1]
    assert max(seen) < 2_000 and joined.tolist() == plain(text).tolist()


def test_rows_and_columns_stay(spark, library):
    long = " ".join(random.Random(3).choice(PARTS) for _ in range(4000))
    values = [(1, "Hello, WORLD", "x"), (None, None, None), (2, "", "y"), (2, "", "y"), (3, "   ", "z"), (4, long, "w"), (4, long, "v"), (None, long, None)]
    df = spark.createDataFrame(values, "doc_id long, text string, ids string").withColumn("at", F.timestamp_micros(F.lit(5)))
    rows = bpe.encode(df, PATH, leaf_chars=500).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "at", "ids"]
    want = sorted((str(i), t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in values)
    assert sorted((str(r.doc_id), r.text or "", np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert bpe.encode(df.limit(0), PATH).count() == 0
    both = bpe.encode(df, PATH, leaf_chars=500, decoded="decoded")
    assert both.columns == ["doc_id", "text", "at", "ids", "decoded"]
    assert [r.a for r in bpe.decode(both, PATH, out="again").select((F.col("again") == F.col("decoded")).alias("a")).collect()] == [True] * len(values)


def test_digests(spark, library):
    long = "Lorem ipsum dolor " * 300 + "x" * 900
    values = [(1, "It's 2 o'clock"), (2, None), (3, long)]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(values, "doc_id long, text string"), PATH, leaf_chars=400).collect()}
    for doc_id, text in values:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
