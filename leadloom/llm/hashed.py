"""What the two classifiers share: a bounded sample of labelled rows, and training rounds over slices of it."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import small_batches
from leadloom.session import materialize

SAMPLE_ROWS = 20_000  # the bound of the learning sample
SLICES = 4
CACHED_TOKENS = 150_000

TOKEN = r"[^\W\d_]+|\d+|[^\w\s]+|_+"


class Hashes(dict):
    """Eight bytes of hash for every token, remembered."""

    def __missing__(self, token: str) -> bytes:
        found = xxhash.xxh64_digest(token)
        if len(token) <= 64:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = found
        return found


class Tokens:
    def __init__(self):
        self.split = re.compile(TOKEN).findall
        self.hashes = Hashes()

    def __call__(self, text: str) -> np.ndarray:
        """Hashes of the tokens of a text: runs of letters, of digits, of other marks."""
        return np.frombuffer(b"".join(map(self.hashes.__getitem__, self.split(text))), ">u8").astype(np.uint64)


def sample(docs: DataFrame, labels: DataFrame, label: str, learning, rows: int = SAMPLE_ROWS, seed: int = 8) -> DataFrame:
    """(doc_id, text, label, slice) of at most ``rows`` labelled documents, chosen by a hash of their id.

    ``learning`` says which ids may be learnt from. A document with several labels counts as 1 if at least half
    of them are; of several texts with one id that of the smallest hash is learnt, so the bound holds for rows. Only ids and labels
    are ordered, at most ``rows`` of them are joined to the texts, and a task hands on one text an id.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learning(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
    chosen = chosen.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).orderBy("order", "doc_id").limit(rows)
    texts = docs.where(learning(F.col("doc_id"))).select("doc_id", "text")
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    return one.select(
        "doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(SLICES)).cast("int").alias("slice"))


def sliced(ready: DataFrame) -> DataFrame:
    """The learning rows with one slice a partition, written once: rounds read them where they lie."""
    return materialize(ready.repartitionById(SLICES, "slice"))


def each_slice(ready: DataFrame, train, shape: str) -> DataFrame:
    """``train`` over every slice of ``sliced`` rows (a table in, a table out); a slice is a quarter of the bounded sample."""
    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            for own in sorted(set(rows.column("slice").to_pylist())):
                yield from train(rows.filter(pc.equal(rows.column("slice"), own))).to_batches()

    return ready.mapInArrow(run, shape)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
