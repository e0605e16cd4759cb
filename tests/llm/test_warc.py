"""Archives: written, read back, and broken on purpose."""

import hashlib
import io
import random
import struct

import pytest
import zstandard

from leadloom.llm import warc

ROWS = [(1, "http://a.example/", "<html>one</html>"), (2, "http://b.example/", "<html>one</html>"), (3, None, None), (4, "http://c.example/ x\n", ""),
        (5, "http://d.example/", "é" * 30_000), (None, "http://e.example/", "<html>one</html>"), (None, "http://f.example/", "only without id"),
        (6, "u", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (6, "v", "another payload")]
ROWS += [(100 + i, "http://hot.example/", "<p>" + "the same page " * 20) for i in range(60)] + [(200 + i, "u", f"<p>page {i} " * 400) for i in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw, to = (html or "").encode(), first.get(html or "")
        same = to is None or i == to
        out.append((i, len(raw), warc.base32_sha1(raw), "response" if same else "revisit", None if same else to))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write(frame(spark, ROWS), folder)
    rows = warc.read(spark, folder).collect()
    assert all(r.problem is None for r in rows)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str) == expected(ROWS)
    for r in rows:
        assert r.record_type == "revisit" or hashlib.sha1(r.payload).digest() and len(r.payload) == r.payload_bytes
    whole = [x for x in rows if x.page_id == 5]
    assert whole[0].payload.decode() == "é" * 30_000


def test_archives_are_plain_zstandard(spark, tmp_path):
    folder = tmp_path / "warc"
    warc.write(frame(spark, ROWS), str(folder))
    seen = 0
    for path in folder.glob("part-*"):
        raw = path.read_bytes()
        if not raw:
            continue
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == warc.DICTIONARY_FRAME
        made = zstandard.ZstdCompressionDict(raw[8:8 + size]) if size else None
        text = zstandard.ZstdDecompressor(dict_data=made).stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        seen += text.count(b"WARC-Record-ID: ")
    assert seen == len(ROWS)


def test_one_id_for_hundreds_of_pages(spark, tmp_path):
    rows = [(7, "u", f"page {i % 90}") for i in range(500)] + [(8, "u", "page 3"), (3, "u", "page 4")]
    folder = str(tmp_path / "warc")
    warc.write(frame(spark, rows), folder)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    """A task's pages go into several archives, each with a dictionary of its own in front."""
    monkeypatch.setattr(warc, "ROW_BYTES", 2000)
    monkeypatch.setattr(warc, "ROWS", 3)
    rng = random.Random(1)
    rows = [(i, "u", " ".join(str(rng.random()) for _ in range(100))) for i in range(400)]
    folder = tmp_path / "warc"
    warc.write(frame(spark, rows).coalesce(1), str(folder))
    sizes = [p.stat().st_size for p in folder.glob("part-*")]
    assert len(sizes) > 20 and max(sizes) < warc.DICTIONARY_BYTES + 3 * 2 * 2000 + 100
    for path in folder.glob("part-*"):
        assert len(list(warc.frames(memoryview(path.read_bytes())))) > 0
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, str(folder)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_no_pages(spark, tmp_path):
    folder = str(tmp_path / "none")
    warc.write(frame(spark, []), folder)
    assert warc.read(spark, folder).count() == 0


def test_a_dictionary_serves_its_archive():
    made = zstandard.train_dictionary(2048, [f"<html><body>a common frame of page {i}</body></html>".encode() * 3 for i in range(500)])
    packer = zstandard.ZstdCompressor(dict_data=made)
    records = [warc.record(i, "u", b"<html><body>page</body></html>", None) for i in range(5)]
    content = struct.pack("<II", warc.DICTIONARY_FRAME, len(made.as_bytes())) + made.as_bytes()
    content += b"".join(packer.compress(r) + warc.EMPTY_FRAME.encode() for r in records)
    assert list(warc.frames(memoryview(content))) == records
    with pytest.raises(ValueError):
        list(warc.frames(memoryview(content[:-30])))


@pytest.mark.parametrize("change, problem", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "no version line or no end of the header"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Data"), "no warc-date"),
    (lambda r: r + b"x", "the length is wrong"),
    (lambda r: r.replace(b"payload", b"payloaD"), "the block digest is wrong"),
    (lambda r: r.replace(b"WARC-Date: ", b"WARC-Date "), "a header line is malformed"),
])
def test_broken_records(change, problem):
    good = warc.record(1, "http://x.example/", b"a payload", None)
    assert warc.parse(good)["problem"] is None and warc.parse(good)["payload"] == b"a payload"
    assert warc.parse(change(good))["problem"] == problem
