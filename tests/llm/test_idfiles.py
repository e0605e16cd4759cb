"""Patched blocks round trip, and files against a running count."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from leadloom.llm import bpe, idfiles


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), min_size=1, max_size=700), st.sampled_from([0.0, 50.0, 98.0, 100.0]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, "<u4")
    assert idfiles.unpack_block(memoryview(idfiles.pack_block(ids, percentile))).tolist() == ids.tolist()


def test_outliers_do_not_widen_a_block():
    ids = np.full(idfiles.BLOCK, 100, "<u4")
    ids[::500] = 4_000_000_000
    assert len(idfiles.pack_block(ids)) < 100 and idfiles.unpack_block(memoryview(idfiles.pack_block(ids))).tolist() == ids.tolist()


def test_a_range_is_read_from_its_blocks():
    ids = (np.arange(20_000) * 7919 % 49408).astype("<u4")
    segment = idfiles.Segment(memoryview(idfiles.pack_segment([5, None], [15_000, 5_000], ids, 0, 0, 98.0)))
    segment.check()
    for a, b in ((0, 1), (4095, 4097), (8192, 12288), (19_990, 20_000), (7, 7)):
        assert segment.read(a, b).tolist() == ids[a:b].tolist()
    assert segment.keys == [5, None]


def test_damage_is_found():
    raw = bytearray(idfiles.pack_segment([1], [3], np.array([1, 2, 3], "<u4"), 0, 0, 98.0))
    raw[-6] ^= 1
    with pytest.raises(ValueError):
        idfiles.Segment(memoryview(raw)).check()
    with pytest.raises(ValueError):
        idfiles.Segment(memoryview(raw)[:40])


def test_files_keep_the_order_of_documents(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = [(int(k), rng.integers(0, 50_000, rng.integers(0, 3000)).astype("<u4").tobytes()) for k in rng.permutation(300)]
    values += [(None, b""), (7, None), (9, np.arange(9000, dtype="<u4").tobytes())]  # repeated ids, no ids
    df = spark.createDataFrame(values, "doc_id long, ids binary")
    folder = str(tmp_path / "ids")
    idfiles.write(idfiles.in_order(df, text="ids"), folder, end_id=1, segment_ids=20_000)
    rows = sorted((r for r in idfiles.documents(spark, folder).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([k for k, _ in values], key=lambda k: (k is not None, k))
    at, left = 0, [(k, (raw or b"") + b"\x01\0\0\0") for k, raw in values]
    for r in rows:
        raw = next(x for k, x in left if k == r.doc_id and len(x) // 4 == r.n_tokens and zlib.crc32(x) == r.ids_crc32)
        left.remove((r.doc_id, raw))
        assert r.start == at
        at += r.n_tokens
    assert not left


def test_files_hold_what_the_library_encodes(spark, tmp_path):
    """From texts to files and back, against the tokenizers library: whole documents, nulls and long texts included."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9000, ""), (9002, "le chat et " * 9000), (9003, " \n")], docs.schema))
    folder = str(tmp_path / "ids")
    idfiles.write(idfiles.in_order(docs), folder, ids="text", to_ids=lambda texts: bpe.codec(path).encode([x or "" for x in texts]), end_id=1)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts, start = {r.doc_id: r.text or "" for r in docs.collect()}, 0
    got = {r.doc_id: r for r in idfiles.documents(spark, folder).collect()}
    assert len(got) == len(texts)
    for key in sorted(texts):
        ids = np.array([*library.encode(texts[key], add_special_tokens=False).ids, 1], "<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    idfiles.write(idfiles.in_order(spark.createDataFrame([], "doc_id long, text string")), folder, ids="text", to_ids=lambda x: [b""] * len(x))
    assert idfiles.documents(spark, folder).count() == 0
