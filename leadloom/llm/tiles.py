"""Vectors in tiles: what exact search and the hash forest share.

Rows are dealt into shards of about ``shard_rows`` by a hash of their id, queries into strips of about ``STRIP_ROWS``. A
task holds one strip and goes through the shards of one slot, a shard at a time, as plain rows that Spark has sorted, so
its memory is that of a strip and a shard however many there are. It hands on one short list per query and slot; lists
are merged in a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import whole_groups

LIST = "part long, query_id long, vec_id long, score {score}"
FAN_IN = 16
STRIP_ROWS = 65536  # every strip more sends all rows to tasks once more
LEAST_SLOTS, SLOT_SHARDS = 64, 16  # every slot more sends all queries to tasks once more; a slot has one shard while there are few


def usable(df: DataFrame, vec_id: str, vector: str, zero_too: bool) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not NULL, no NULL or non-finite component, not empty, and not zero
    unless ``zero_too``. Rows without id take no part. Components stay single precision where they are."""
    kind = "array<float>" if isinstance(df.select(vector).schema[0].dataType.elementType, T.FloatType) else "array<double>"
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine)
    if not zero_too:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))


def once(ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending; rows that repeat id and vector, which always meet in one shard, are one row."""
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    if (ids[1:] == ids[:-1]).any():
        first = {(i, v.tobytes()): at for at, (i, v) in reversed(list(enumerate(zip(ids.tolist(), matrix))))}
        kept = sorted(first.values())
        ids, matrix = ids[kept], matrix[kept]
    return ids, matrix


def asked(rows: DataFrame, is_query) -> DataFrame:
    """The query rows, one for each id: of different vectors with one id, the smallest."""
    return rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))


def dealt(rows: DataFrame, queries: DataFrame, shards: int, slots: int, strips: int) -> DataFrame:
    """(task, dim, shard, vec_id, v), sorted: a task's queries, as shard -1, before its shards; no two dimensions share a matrix."""
    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dim = F.size("v").alias("dim")
    index = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), dim, "vec_id", "v", every(strips).alias("strip"))
    index = index.select((F.col("strip") * slots + F.col("shard") % slots).alias("task"), "dim", "shard", "vec_id", "v")
    of = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(strips)).cast("int")
    queries = queries.select(of.alias("strip"), dim, "vec_id", "v", every(slots).alias("slot"))
    queries = queries.select((F.col("strip") * slots + F.col("slot")).alias("task"), "dim", F.lit(-1).alias("shard"), "vec_id", "v")
    return index.unionByName(queries).repartitionById(strips * slots, "task").sortWithinPartitions("task", "dim", "shard")


def search(rows: DataFrame, is_query, shard_rows: int, block_rows: int, k: int, score: str, begin) -> DataFrame:
    """query_id, rank, vec_id, score of the k best. ``begin(query ids, matrix)`` starts a strip: what it returns has ``add(ids, matrix)``
    for every shard and ``lists()``, the query ids, ids and scores of the k best of what was added."""
    counted = rows.select(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-counted[0] // shard_rows)), max(1, -(-counted[1] // block_rows))
    slots, strips = min(shards, max(LEAST_SLOTS, -(-shards // SLOT_SHARDS))), max(1, -(-counted[1] // STRIP_ROWS))

    def run(batches):
        key = strip = None
        for batch, edges in whole_groups(batches, ["task", "dim", "shard"]):
            tasks, dims, parts, ids, vectors = (batch.column(name) for name in ("task", "dim", "shard", "vec_id", "v"))
            for low, high in zip(edges.tolist(), edges[1:].tolist()):
                here = tasks[low].as_py(), dims[low].as_py()
                query = parts[low].as_py() < 0
                if strip is not None and here != key:
                    yield output(key[0] % slots, *strip.lists())
                    strip = None
                if strip is None and not query:  # nothing asks for vectors of this length
                    continue
                matrix = vectors.slice(low, high - low).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(high - low, here[1])
                found = once(ids.slice(low, high - low).to_numpy(), matrix)
                if query:
                    key, strip = here, begin(*found)
                else:
                    strip.add(*found)
        if strip is not None:
            yield output(key[0] % slots, *strip.lists())

    queries = asked(rows, is_query)
    lists = dealt(rows, queries, shards, slots, strips).mapInArrow(run, LIST.format(score=score))
    return ranked(merge_lists(lists, slots, blocks, k, score), k)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every query, queries ascending, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores if scores.dtype == np.float64 else ~scores, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def merge_lists(lists: DataFrame, parts: int, blocks: int, k: int, score: str) -> DataFrame:
    """Merge the short lists of each query up a tree: at every level ``FAN_IN`` parts of a block of queries become one."""
    def merge(table):
        return table.take(pa.array(best(*(table.column(c).to_numpy() for c in ("query_id", "vec_id", "score")), k)))

    lists = lists.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).cast("long"))
    while True:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.expr(f"part div {FAN_IN}")).select("block", "part", "query_id", "vec_id", "score")
        lists = lists.groupBy("block", "part").applyInArrow(merge, "block long, " + LIST.format(score=score))
        if parts <= 1:
            return lists


def ranked(lists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from merged lists: at most k rows a query, which is all that a window holds."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (lists.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def output(part, query_id, vec_id, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(query_id), part), pa.int64()), pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score)],
        names=["part", "query_id", "vec_id", "score"])
