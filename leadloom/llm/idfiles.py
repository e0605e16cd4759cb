"""Token ids in binary files: patched frame-of-reference blocks, in the order of the documents.

Documents are range-partitioned by key and every task appends its ids to a file of its own through
Spark's text sink, whose rows are raw bytes here and whose commit protocol drops the files of failed
attempts. A file is a row of segments, each of which can be read alone:

    header     b"PFOR", bytes of the segment, partition, ids of the partition before it, documents, ids, blocks
    documents  key is NULL (u1 each), key (i8 each), ids (u4 each)
    blocks     byte at which each block starts, from the end of this table (u4 each)
    block      minimum (u4), ids (u2), width (u1), exceptions (u2), packed low bits, positions (u2 each), values (u4 each)
    trailer    crc32 of all before (u4)

A block holds up to 4096 ids less the block's minimum, packed at the width that the given percentile
of them needs; the rest are exceptions, stored whole. A separator byte follows each segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.common import small_batches

BLOCK = 4096
SEGMENT_IDS = 1 << 20  # a segment is closed once it holds as many; one document is never split
SEGMENTS_PER_FILE = 8
PERCENTILE = 98.0
MAGIC = b"PFOR"
HEADER = "<4sqqqqqq"
BLOCK_HEADER = "<IHBH"


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = ids.min()
    rest = (ids - low).astype("<u4")
    at = int(np.ceil(percentile / 100 * (len(rest) - 1)))
    width = int(np.partition(rest, at)[at]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    packed = b""
    if width == 16:
        packed = rest.astype("<u2").tobytes()
    elif width:
        bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
        packed = np.packbits(bits, bitorder="little").tobytes()
    return (struct.pack(BLOCK_HEADER, int(low), len(rest), width, len(over)) + packed
            + over.astype("<u2").tobytes() + rest[over].tobytes())


def unpack_block(data: memoryview) -> np.ndarray:
    low, count, width, exceptions = struct.unpack_from(BLOCK_HEADER, data)
    start = struct.calcsize(BLOCK_HEADER)
    size = (count * width + 7) // 8
    raw = np.frombuffer(data, np.uint8, size, start)
    if width == 16:
        rest = raw.view("<u2").astype("<u4")
    else:
        rest = np.zeros(count, "<u4")
        if width:
            bits = np.unpackbits(raw, bitorder="little", count=count * width).reshape(count, width)
            octets = np.packbits(bits, axis=1, bitorder="little")
            rest.view(np.uint8).reshape(count, 4)[:, :octets.shape[1]] = octets
    where = np.frombuffer(data, "<u2", exceptions, start + size)
    rest[where] = np.frombuffer(data, "<u4", exceptions, start + size + 2 * exceptions)
    return rest + np.uint32(low)


def pack_segment(keys: list, lengths: list[int], ids: np.ndarray, partition: int, before: int, percentile: float) -> bytes:
    blocks = [pack_block(ids[i:i + BLOCK], percentile) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u4")
    body = b"".join([np.array([k is None for k in keys], "u1").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
                     np.array(lengths, "<u4").tobytes(), starts.tobytes(), *blocks])
    head = struct.pack(HEADER, MAGIC, struct.calcsize(HEADER) + len(body) + 4, partition, before, len(keys), len(ids), len(blocks))
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


class Segment:
    """A segment of a file, of which any range of ids can be read without the rest."""

    def __init__(self, data: memoryview):
        if len(data) < struct.calcsize(HEADER):
            raise ValueError("a segment is cut short")
        magic, self.bytes, self.partition, self.before, docs, self.ids, blocks = struct.unpack_from(HEADER, data)
        if magic != MAGIC or self.bytes > len(data):
            raise ValueError("not a segment, or cut short")
        self.data = data[:self.bytes]
        at = struct.calcsize(HEADER)
        nulls = np.frombuffer(data, "u1", docs, at)
        keys = np.frombuffer(data, "<i8", docs, at + docs)
        self.keys = [None if null else key for null, key in zip(nulls.tolist(), keys.tolist())]
        self.lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
        self.starts = np.frombuffer(data, "<u4", blocks, at + 13 * docs)
        self.first = at + 13 * docs + 4 * blocks

    def check(self) -> None:
        if zlib.crc32(self.data[:-4]) != struct.unpack_from("<I", self.data, self.bytes - 4)[0]:
            raise ValueError("a segment's checksum is wrong")

    def read(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, "<u4")
        first = start // BLOCK
        parts = [unpack_block(self.data[self.first + int(self.starts[b]):]) for b in range(first, (stop - 1) // BLOCK + 1)]
        return np.concatenate(parts)[start - first * BLOCK:stop - first * BLOCK]


def segments(content: memoryview):
    at = 0
    while at < len(content):
        found = Segment(content[at:])
        yield found
        at += found.bytes + 1


def write(df: DataFrame, folder: str, key: str = "doc_id", ids: str = "ids", to_ids=None, end_id: int | None = None,
          percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of every row to files below ``folder``, in the order in which the partitions hold the rows.

    ``df`` is range-partitioned and sorted within partitions already (see ``in_order``). ``key`` is a
    64-bit integer or NULL, ``ids`` little-endian unsigned 32-bit integers in binary (NULL: none), or
    whatever ``to_ids`` turns into a list of such values, in lists of up to 256; ``end_id`` is appended
    to each. Repeated keys stay separate documents.
    """
    end = np.array([end_id], "<u4").tobytes() if end_id is not None else b""

    def run(batches):
        partition, before = TaskContext.get().partitionId(), 0
        keys, parts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                values = some.column(1).to_pylist()
                for k, raw in zip(some.column(0).to_pylist(), to_ids(values) if to_ids else values):
                    keys.append(k)
                    parts.append((raw or b"") + end)
                    size += len(parts[-1]) // 4
                    if size >= segment_ids:
                        yield segment(keys, parts, partition, before)
                        keys, parts, size, before = [], [], 0, before + size
        if keys:
            yield segment(keys, parts, partition, before)

    def segment(keys, parts, partition, before):
        joined = np.frombuffer(b"".join(parts), "<u4")
        raw = pack_segment(keys, [len(x) // 4 for x in parts], joined, partition, before, percentile)
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["segment"])

    small_batches(df.sparkSession)
    packed = df.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "segment binary")
    # bytes cast to a string stay as they are, and the text sink writes them so
    (packed.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(folder))


def in_order(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in ascending key order over all partitions, NULL first; rows with equal keys are told apart by their text."""
    tie = F.xxhash64(text)
    return df.repartitionByRange(F.col(key), tie).sortWithinPartitions(F.col(key), tie)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("content")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    The ids are decoded and every segment's checksum is verified; a damaged file fails the job. How many
    ids precede a partition comes from the segment headers, one row per partition that was written,
    which is what bounds the broadcast.
    """
    def headers(batches):
        for batch in batches:
            found = [(s.partition, s.ids) for x in batch.column(0) for s in segments(memoryview(x.as_buffer()))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)],
                                             names=["partition", "ids"])

    def rows(batches):
        for batch in batches:
            for x in batch.column(0):
                for s in segments(memoryview(x.as_buffer())):
                    s.check()
                    ends = np.cumsum(s.lengths, dtype=np.int64)
                    raw = memoryview(s.read(0, s.ids).tobytes())
                    sums = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), s.lengths.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.keys, pa.int64()), pa.array(np.full(len(ends), s.partition)), pa.array(s.before + ends - s.lengths),
                         pa.array(s.lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                        names=["doc_id", "partition", "inside", "n_tokens", "ids_crc32"])

    files = _files(spark, folder)
    totals = files.mapInArrow(headers, "partition long, ids long").groupBy("partition").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("partition", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    found = files.mapInArrow(rows, "doc_id long, partition long, inside long, n_tokens long, ids_crc32 long")
    return (found.join(F.broadcast(offsets), "partition")
            .select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
