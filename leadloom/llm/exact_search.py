"""Exact top-k by integer inner product: tiled matrix products, partial selection per tile, lists merged in a tree.

A task keeps the k best of its queries while it goes through its shards, so of a tile only scores that reach a query's k-th best so
far are looked at; where they are many, as with equal vectors, the k best of every row are selected.

Scores are exact. Products run in double precision while no sum of them can leave 2**53, which real
embeddings never do; beyond that a tile falls back to Python integers, and a score outside 64 bits is
held at the border of its range, as is a component beyond 2**55. Vectors that are NULL, empty, or hold NULL or non-finite components
take no part; vectors of another length than the query's are no candidates of it. Rows that repeat id
and vector are one; rows that share an id only are candidates each, and the query's own id is none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import tiles

SHARD_ROWS = 8192
BLOCK_ROWS = 512
SCALE = 256.0
SHARE = 8  # of a first tile, one column in so many gives a bound
MANY = 32  # times k: so many scores a query of a tile are sorted as they are


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of every row, ties to the smaller column; columns where ``own`` holds are left out."""
    n = scores.shape[1]
    keys = scores * n + np.arange(n - 1, -1, -1)  # no two alike
    keys[own] = np.iinfo(np.int64).min
    k = min(k, n)
    best = np.argpartition(keys, n - k, axis=1)[:, n - k:] if k < n else np.tile(np.arange(n), (len(keys), 1))
    rows = np.repeat(np.arange(len(keys)), k)
    columns = best.ravel()
    fine = ~own[rows, columns]
    return rows[fine], columns[fine]


def _exact_tile(queries, query_ids, shard, ids, k):
    """The same by Python integers, row by row."""
    low, high = -(1 << 63), (1 << 63) - 1
    whole = [[int(x) for x in row] for row in shard]
    rows, columns, scores = [], [], []
    for q, own in enumerate(query_ids):
        vector = [int(x) for x in queries[q]]
        found = [(-min(high, max(low, sum(a * b for a, b in zip(vector, row)))), j) for j, row in enumerate(whole) if ids[j] != own]
        for minus, j in sorted(found)[:k]:
            rows.append(q)
            columns.append(j)
            scores.append(-minus)
    return np.array(rows, int), np.array(columns, int), np.array(scores, np.int64)


class Strip:
    """Queries of one length and the k best of every one among the shards so far."""

    def __init__(self, ids, queries, k, block_rows):
        self.ids, self.queries, self.k, self.block_rows = ids, queries, k, block_rows
        self.found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)  # query, id, score
        self.least = np.full(len(ids), -np.inf)  # the k-th best score of every query that has k
        self.room = np.empty(0)

    def tile(self, low: int, ids: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and exact score of what can be among the k best of a block of queries."""
        queries, own, n = self.queries[low:low + self.block_rows], self.ids[low:low + self.block_rows], len(ids)
        bound = np.abs(queries).max() * np.abs(shard).max() * queries.shape[1]
        if bound >= min(2.0 ** 53, 2.0 ** 62 / (n + 1)):  # sums might leave what doubles and the selection's keys hold exactly
            return _exact_tile(queries, own, shard, ids, self.k)
        if len(self.room) < len(queries) * n:
            self.room = np.empty(len(queries) * n)
        scores = np.matmul(queries, shard.T, out=self.room[:len(queries) * n].reshape(len(queries), n))
        least, some = self.least[low:low + len(queries)], n // SHARE
        if some > self.k and np.isinf(least).any():  # the k-th best of some columns is a bound as well
            first = np.where(own[:, None] == ids[None, :some], -np.inf, scores[:, :some])
            least = np.maximum(least, np.partition(first, some - self.k, axis=1)[:, some - self.k])
        reach = scores >= least[:, None]
        if np.count_nonzero(reach) > MANY * self.k * len(queries):
            at, of = select(scores.astype(np.int64), own[:, None] == ids[None, :], self.k)
        else:
            at, of = np.divmod(np.flatnonzero(reach), n)
            others = own[at] != ids[of]
            at, of = at[others], of[others]
        return at, of, scores[at, of].astype(np.int64)

    def add(self, ids: np.ndarray, shard: np.ndarray) -> None:
        parts = [self.found]
        for low in range(0, len(self.ids), self.block_rows):
            at, of, scores = self.tile(low, ids, shard)
            parts.append((at + low, ids[of], scores))
        together = [np.concatenate(x) for x in zip(*parts)]
        kept = tiles.best(*together, self.k)
        self.found = tuple(x[kept] for x in together)
        count = np.bincount(self.found[0], minlength=len(self.ids))
        full, last = count == self.k, np.cumsum(count) - 1
        self.least[full] = self.found[2][last[full]]

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.found[0]], self.found[1], self.found[2]


def search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
           shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query row against all other rows."""
    rows = tiles.usable(df, vec_id, vector, zero_too=True)
    # the whole number below a single-precision component, times a power of two, is one of single precision as well
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).cast(rows.schema["v"].dataType))
    return tiles.search(rows, is_query, shard_rows, block_rows, k, "long", lambda ids, queries: Strip(ids, queries, k, block_rows))
