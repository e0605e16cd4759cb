"""Web archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: every task's partition becomes archives of bounded size, written through Spark's text sink, whose rows are
raw bytes here: some megabytes of frames each. The sink's line separator is an empty skippable frame, so every archive is a valid
Zstandard file; the sink begins a new file after so many rows, and the row that it begins with has a dictionary frame of its own. Reading: frame by frame, so that a record is all that is ever decoded at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import small_batches
from leadloom.scale import join_summary
from leadloom.session import materialize

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:%s>"

DICTIONARY_BYTES = 32768
SAMPLE_ROWS, SAMPLE_CHARS = 256, 8192  # what the dictionary is trained on, at most
CAPTURED = "1970-01-01T00:00:00Z"
LEVEL = 3
ROW_BYTES, ROWS = 4 << 20, 32  # frames of a row, rows of an archive: about 128 MB and a record at most
STEP = 8192


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def first_copies(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(page_id, payload digest, refers_to) of every page whose payload a page of a smaller id holds as well.

    Digests are written once (checkpoint) and grouped; a payload that a third of the pages share is met
    through the summary join, never in one task.
    """
    content = F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))
    digests = materialize(pages.select(F.col(page_id).alias("page_id"), F.sha1(content).alias("digest")))
    groups = (digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) & F.col("refers_to").isNotNull()))
    found = join_summary(digests, groups, ["digest"], "n", how="inner")
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def train_dictionary(pages: DataFrame, payload: str = "html") -> bytes:
    """A dictionary from a bounded sample (``SAMPLE_ROWS`` pages, ``SAMPLE_CHARS`` of each); empty if that is too little."""
    content = F.substring(payload, 1, SAMPLE_CHARS)
    rows = pages.where(F.length(payload) > 0).select(content.alias("text")).orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS).collect()
    sample = [r[0].encode() for r in rows]
    if len(sample) < 16 or sum(map(len, sample)) < 4 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:  # too uniform to train on
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, captured: str = CAPTURED) -> bytes:
    """A response record, or a revisit record without payload; its HTTP header tells the payload's length either way."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {RECORD_ID % ('' if page_id is None else page_id)}",
            f"WARC-Date: {captured}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
            f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {RECORD_ID % refers_to}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str) -> None:
    """Write one record per row of (page_id, url, html) to archives below ``folder``.

    Of pages with equal payloads (empty ones too) those with the smallest id are responses, the others
    revisits. NULL html counts as empty, a NULL url as an empty one; rows without id are written too
    and revisit the copy that has one. Rows meet their copies by (id, digest), so html is shuffled once.
    """
    dictionary = train_dictionary(pages)
    content = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    copies = first_copies(pages).select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "refers_to")
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(content))
    rows = rows.join(copies, F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest")), "left")

    def run(batches):
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True, write_checksum=True)
        held, size, made_rows = [], 0, 0

        def row():
            nonlocal held, size, made_rows
            lead = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary] if made_rows % ROWS == 0 else []
            out = pa.RecordBatch.from_arrays([pa.array([b"".join(lead + held)], pa.binary())], names=["frame"])
            held, size, made_rows = [], 0, made_rows + 1
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page in batch.slice(at, 256).to_pylist():
                    held.append(packer.compress(record(page["page_id"], page["url"], (page["html"] or "").encode(), page["refers_to"])))
                    size += len(held[-1])
                    if size >= ROW_BYTES:
                        yield row()
        if held:
            yield row()

    small_batches(pages.sparkSession)
    frames = rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", ROWS).text(folder)


def frames(content: memoryview):
    """Decode the frames of an archive one by one; the dictionary comes from its first frame."""
    unpacker, at = zstandard.ZstdDecompressor(), 0
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at) if at + 8 <= len(content) else (0, 0)
        if magic in SKIPPABLE:
            if at + 8 + size > len(content):
                raise ValueError("a skippable frame is cut short")
            if magic == DICTIONARY_FRAME and at == 0 and size:
                own = bytes(content[8:8 + size])
                if own[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may be compressed itself
                    own = zstandard.ZstdDecompressor().decompress(own)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
            at += 8 + size
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("a frame is cut short")
            piece = content[at:at + STEP]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


FIELD = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*([^\r\n]*)\r\n")


def parse(raw: bytes) -> dict:
    """Headers, block and payload of a record; ``problem`` says what is wrong with it, if anything."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(VERSION) or end < 0:
        return {"problem": "no version line or no end of the header"}
    lines = raw[len(VERSION):end + 2]
    fields = FIELD.findall(lines)
    head = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in fields}
    if sum(len(m) for m in FIELD.split(lines)[::3]):
        return head | {"problem": "a header line is malformed"}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            return head | {"problem": f"no {name}"}
    if not head["content-length"].isdigit() or len(raw) != end + 4 + int(head["content-length"]) + 4 or not raw.endswith(b"\r\n\r\n"):
        return head | {"problem": "the length is wrong"}
    block = raw[end + 4:-4]
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        return head | {"problem": "the block digest is wrong"}
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
    head |= {"payload": payload, "payload_bytes": int(length[1]) if length else len(payload), "problem": None}
    if head["warc-type"] == "response":
        if len(payload) != head["payload_bytes"]:
            head["problem"] = "the payload's length is wrong"
        elif head.get("warc-payload-digest") != f"sha1:{base32_sha1(payload)}":
            head["problem"] = "the payload digest is wrong"
    elif head["warc-type"] == "revisit" and "warc-refers-to" not in head:
        head["problem"] = "a revisit refers to nothing"
    return head


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record below ``folder``: id, type, target, digest, length, what it refers to, payload, and what is wrong with it."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for raw in frames(memoryview(content.as_buffer())):
                    held.append(parse(raw))
                    size += len(raw)
                    if size > 8_000_000 or len(held) >= 1024:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    def number(x):
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")
        return int(found[1]) if found else None

    def rows(held):
        def column(name, kind):
            return pa.array([h.get(name) for h in held], kind)

        return pa.RecordBatch.from_arrays(
            [pa.array([number(h.get("warc-record-id")) for h in held], pa.int64()), column("warc-type", pa.string()),
             column("warc-target-uri", pa.string()), pa.array([h.get("warc-payload-digest", "").removeprefix("sha1:") for h in held]),
             column("payload_bytes", pa.int64()), pa.array([number(h.get("warc-refers-to")) for h in held], pa.int64()),
             column("payload", pa.binary()), column("problem", pa.string())],
            names=["page_id", "record_type", "target", "payload_digest", "payload_bytes", "refers_to", "payload", "problem"])

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, target string, payload_digest string, payload_bytes long, "
                                 "refers_to long, payload binary, problem string")
