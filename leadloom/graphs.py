"""Connected components of edges that no machine holds whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import materialize

CHUNK = 1 << 19  # edges that a task contracts at once


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[one], label[other])
        after = label.copy()
        np.minimum.at(after, label[one], low)
        np.minimum.at(after, label[other], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task holds, chunk by chunk, as stars around smallest nodes: a node has one edge down a chunk, however many it had."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        a, b = contracted(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= CHUNK:
            yield out()
            held = []
    if held:
        yield out()


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b), all of one a together: its smallest b is its parent, and every other b hangs on that one (``own`` false)."""
    last = first = None
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(a):
            continue
        new = np.r_[last is None or a[0] != last, a[1:] != a[:-1]]
        parent = np.where(new, b, 0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        parent = np.where(at >= 0, b[np.maximum(at, 0)], first if first is not None else 0)
        last, first = a[-1], parent[-1]
        hung = ~new & (b != parent)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[a[new], b[hung]]), pa.array(np.r_[b[new], parent[hung]]),
                                          pa.array(np.r_[np.ones(int(new.sum()), bool), np.zeros(int(hung.sum()), bool)])], names=["a", "b", "own"])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of the edges (a, b), whole numbers: the smallest node that can be reached.

    Tasks contract what they hold to stars first, so a node with very many neighbours keeps one edge a task. Then, in rounds: every node takes the
    smallest of its lower neighbours as its parent, the others of them hang on that one, and parents are replaced by their own
    parents, which halves the way to the smallest node. A parent that many share is met by a join whose skew Spark splits. Rounds
    go through ``spark.checkpoint.dir``; they grow with the logarithm of the longest way.
    """
    shape = "a long, b long"
    apart = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = apart.mapInArrow(_stars, shape)
    for _ in range(rounds):
        found = materialize(edges.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_parents, f"{shape}, own boolean"))
        above = found.where("own").select(F.col("a").alias("p"), F.col("b").alias("grand"))
        jumped = found.join(above, F.col("b") == F.col("p"), "left")
        jumped = materialize(jumped.select("a", F.coalesce("grand", "b").alias("b"), "own", F.col("grand").isNotNull().alias("moved")))
        if jumped.where("moved OR NOT own").isEmpty():
            break
        edges = jumped.select("a", "b").mapInArrow(_stars, shape)
    else:
        raise RuntimeError("components did not settle")
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
