"""Similarity join of texts by their sets of word n-grams: every pair with a Jaccard similarity of at least ``p / q`` is a link.

Texts with one set are one node. Whole sets never meet a whole corpus; three steps narrow it down, none of which loses a link:

Size-banded tiles. Sizes are cut into bands, each ``q / p`` times as wide as the one before. Similar sets A and B, |A| <= |B|,
differ in at most k = (q - p) / p |A| shingles, so of ``k + 1 + spare`` classes that the hash space is cut into at least
``spare + 1`` hold the same shingles in both. A node goes to one tile per class, named by band, class and the class's contents,
of its own band and of the one below if a similar set can lie there. Classes without a shingle say nothing and are
left out, unless a node has more than ``spare`` of them (then a pair may agree in nothing else).

Bitmaps. A node's signature is the parity of its shingles per hashed bit. Bits that differ are at least as
many shingles that only one set has, so (|A| + |B| - differing bits) / 2 bounds the overlap from above. A tile keeps a spanning
forest of the pairs within that bound; pairs that are already connected are not looked at again.

Intersections. The trees of those forests hold every link. Sorted arrays of a tree's shingles are intersected, again only
for pairs that are not connected yet, so a dense family costs about one intersection a node.

Tiles and trees of any size: a hot one is cut into parts that are settled on their own, each with the group's first node in it;
pairs of parts meet only if something in them is still unconnected. Neither pairs nor groups are ever held whole.

Shingles are 64-bit hashes (XXH64), nodes 64-bit hashes of the sorted shingles.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.graphs import components
from leadloom.llm.common import fresh, map_text, small_batches, whole_groups, written
from leadloom.llm.simhash import shingle_hashes
from leadloom.scale import join_summary
from leadloom.session import materialize

WORDS = 4
SIMILAR = (85, 100)
PART_NODES = 4096  # of a group that are settled in one go
PART_BYTES = 1 << 24
MOST_BITS = 1 << 16  # of a bitmap; longer sets fill it more, which only weakens the bound
REMEMBERED = 1 << 20  # nodes and groups that a task leaves out when they come again; the shuffle drops all others


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending; none for a text without words."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes())).view(np.int64))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every 64-bit value spread over all bits (splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache
def bands(p: int, q: int) -> np.ndarray:
    """First size of each band: every band reaches up to what can be similar to its first size."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, -(-first[-1] * q // p)))
    return np.array(first)


def tiles_of(shingles: np.ndarray, p: int, q: int) -> np.ndarray:
    """The tiles of one set, as 64-bit names."""
    first, size = bands(p, q), len(shingles)
    if not size:
        return np.zeros(0, np.uint64)
    sums, found = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles), dtype=np.uint64)]), []
    low, high = np.searchsorted(first, [-(-size * p // q), size], "right") - 1
    for band in range(low, high + 1):
        differ = int(first[band + 1] - 1) * (q - p) // p
        if not differ:  # sets of this band are equal or no link
            continue
        spare = 1 + (differ + 1) // 16
        classes = differ + 1 + spare
        borders = np.arange(1, classes, dtype=np.uint64) * np.uint64((1 << 64) // classes)
        at = np.concatenate([[0], np.searchsorted(shingles, borders), [size]])
        held = np.diff(at)
        if np.count_nonzero(held == 0) <= spare:
            kept = np.flatnonzero(held)
        else:
            kept = np.arange(classes)
        contents = sums[at[1:][kept]] - sums[at[:-1][kept]] + held[kept].astype(np.uint64)
        found.append(mixed(mixed(contents) + np.uint64(band << 40) + kept.astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per bit; the number of bits is the power of two that is not below the size, 64 at least."""
    bits = min(MOST_BITS, max(64, 1 << max(0, len(shingles) - 1).bit_length()))
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Rows of 64-bit words, all as long as the shortest bitmap: halves of a longer one are added up bit by bit."""
    least = min(len(x) for x in bitmaps)
    if all(len(x) == least for x in bitmaps):
        return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in bitmaps])


def overlap(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(one) > len(other):
        one, other = other, one
    at = np.searchsorted(other, one)
    return int(np.count_nonzero(other[np.minimum(at, len(other) - 1)] == one)) if len(other) else 0


def forest(sizes: np.ndarray, words: np.ndarray, labels: np.ndarray, p: int, q: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect all that is linked: within the bitmaps' bound, and by intersection if there are sets.

    Positions of one label are connected already.
    """
    labels, found, left = labels.copy(), [], len(np.unique(labels))
    for i in range(len(sizes) - 1):
        if left == 1:
            break
        rest = i + 1 + np.flatnonzero(labels[i + 1:] != labels[i])
        both = sizes[rest] + sizes[i]
        fine = (q * np.minimum(sizes[rest], sizes[i]) >= p * np.maximum(sizes[rest], sizes[i]))
        differ = np.bitwise_count(words[rest] ^ words[i]).sum(1, dtype=np.int64)
        for j in rest[fine & ((both - differ) * (p + q) >= 2 * p * both)].tolist():
            if labels[j] == labels[i]:
                continue
            if sets is not None:
                common = overlap(sets[i], sets[j])
                if q * common < p * (len(sets[i]) + len(sets[j]) - common):
                    continue
            found.append((i, j))
            labels[labels == labels[j]] = labels[i]
            left -= 1
    return found


def tiles(texts: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(grp, part, parts, node): nodes that share a tile, equal groups once; of ``text`` alone."""
    small_batches(texts.sparkSession)

    def deal(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, nodes = [], []
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, words)
                node = node_of(own)
                if node in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(node)
                keys.append(tiles_of(own, p, q))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["tile", "node"])
        pa.default_memory_pool().release_unused()

    def gather(batches):
        """Tiles of two or more nodes; a tile of any size goes out in parts, each with the tile's first node in it."""
        tile, node, part, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, set()

        def lists(names, parts, groups):
            ends = np.cumsum([0] + [len(g) for g in groups])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts, pa.int32()),
                                               pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(groups)))], names=["grp", "part", "nodes"])

        for batch in chain(batches, [None]):
            if batch is not None:
                tile, node = np.concatenate([tile, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
                new = np.ones(len(tile), bool)
                new[1:] = (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])
                tile, node = tile[new], node[new]
                if len(tile) < PART_NODES:
                    continue
            if not len(tile):
                break
            edges = np.concatenate([[0], 1 + np.flatnonzero(tile[1:] != tile[:-1]), [len(tile)]])
            closed = len(edges) - 1 - (batch is not None)  # the last tile may go on
            begin = int(part > 0 and closed > 0)
            if begin:  # the end of a tile that came in parts
                if edges[1] > 1:
                    yield lists([tile[0]], [part + 1], [node[:edges[1]]])
                part = 0
            starts, ends = edges[begin:closed], edges[begin + 1:closed + 1]
            starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
            if len(starts):  # groups are named by what they hold, so that equal ones are one
                spread = mixed(node.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
                names, once = np.unique((before[ends] - before[starts]).view(np.int64), return_index=True)
                fine = [i for i, name in zip(once.tolist(), names.tolist()) if name not in seen]
                if len(seen) < REMEMBERED:
                    seen.update(names.tolist())
                if fine:
                    own = (before[ends[fine]] - before[starts[fine]]).view(np.int64)
                    yield lists(own, [-1] * len(fine), [node[starts[i]:ends[i]] for i in fine])
            tile, node = tile[edges[closed]:], node[edges[closed]:]
            if len(tile) >= PART_NODES:
                part += 1
                yield lists([tile[0]], [part], [node])
                tile, node = tile[:1], node[:1]

    dealt = texts.mapInArrow(deal, "tile long, node long")
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "node")
    return dealt.mapInArrow(gather, "grp long, part int, nodes array<long>").dropDuplicates(["grp", "part"])


def settle(members: DataFrame, payload: DataFrame, connect) -> DataFrame:
    """(a, b): a forest over the nodes of every group (grp, part, node), part after part and then pairs of parts.

    ``payload`` has one row (node, size, data) per node. ``connect(sizes, data, labels)`` gives pairs of positions.
    """
    def run(batches):
        for rows, edges in whole_groups(batches, ["grp", "part", "other"]):
            node, label, size = (rows.column(c).to_numpy() for c in ("node", "label", "size"))
            data, made = rows.column("data"), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own, at = np.unique(node[a:b], return_index=True)
                if len(own) > 1:
                    held = [data[a + i].as_buffer() for i in at.tolist()]
                    made += [(own[i], own[j]) for i, j in connect(size[a:b][at], held, label[a:b][at])]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64())], names=["a", "b"])

    def compared(rows):
        rows = rows.join(payload, "node").select("grp", "part", "other", "node", "label", "size", "data")
        return rows.repartition("grp", "part", "other").sortWithinPartitions("grp", "part", "other").mapInArrow(run, "a long, b long")

    alone = materialize(compared(members.select("grp", "part", F.lit(-1).alias("other"), "node", F.col("node").alias("label"))))
    cut = members.where("part > 0")
    if cut.isEmpty():
        return alone
    labels = components(alone)
    cut = cut.join(labels, "node", "left").select("grp", "part", "node", F.coalesce("component", "node").alias("label"))
    cut = materialize(cut)
    span = cut.groupBy("grp", "part").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left = span.select("grp", "part", "low", "high")
    right = span.select("grp", F.col("part").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    open_ = F.least("low", "low2") != F.greatest("high", "high2")
    meet = materialize(left.join(right, "grp").where((F.col("part") < F.col("other")) & open_).select("grp", "part", "other"))
    if meet.isEmpty():
        return alone
    sides = [meet.join(cut.withColumnRenamed("part", "own"), "grp").where(F.col(side) == F.col("own")).select("grp", "part", "other", "node", "label")
             for side in ("part", "other")]
    return alone.unionByName(compared(sides[0].unionByName(sides[1])))


def links(texts: DataFrame, nodes: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(a, b): links that connect all that similar sets connect. ``texts`` is (text_hash, text), ``nodes`` one row
    (node, size, bitmap, text_hash) per set that is not empty, with the hash of one of its texts."""
    p, q = similar
    nodes_of_tiles = materialize(tiles(texts.select("text"), words, p, q))
    members = nodes_of_tiles.select("grp", "part", F.explode("nodes").alias("node"))
    bitmaps = nodes.select("node", "size", F.col("bitmap").alias("data"))
    near = settle(members, bitmaps, lambda sizes, data, labels: forest(sizes, folded([x.to_pybytes() for x in data]), labels, p, q))

    trees = components(near)
    trees = written(trees.join(nodes.select("node", "size", "text_hash"), "node"), "trees")  # a table, whose size Spark knows
    asked = trees.select("text_hash", "node")
    small_batches(texts.sparkSession)

    def describe(batches):
        seen: set[int] = set()
        for batch in batches:
            made = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node not in seen:
                    own = shingle_set(text, words)
                    made.append((node, len(own), own.astype("<u8").tobytes()))
                    if len(seen) < REMEMBERED:
                        seen.add(node)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), (pa.int64(), pa.int64(), pa.binary()))] if made else
                                             [pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.binary())], names=["node", "size", "data"])

    # copies of a text meet the one row of its hash: adaptive execution splits that join, whose small side is no aggregate of the key
    sets = texts.join(asked, "text_hash").select("node", "text").mapInArrow(describe, "node long, size long, data binary")
    weight = trees.groupBy("component").agg(F.sum(8 * F.col("size")).alias("held"), F.count(F.lit(1)).alias("n"))
    weight = weight.select("component", "n", F.greatest(F.ceil(F.col("held") / PART_BYTES), F.ceil(F.col("n") / PART_NODES)).cast("int").alias("parts"))
    dealt = join_summary(trees, weight, ["component"], "n")
    own = F.when(F.col("parts") == 1, F.array(F.lit(-1))).when(F.col("node") == F.col("component"), F.sequence(F.lit(1), F.col("parts")))
    own = own.otherwise(F.array((1 + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")))
    members = dealt.select(F.col("component").alias("grp"), F.explode(own).alias("part"), "node")

    def connect(sizes, data, labels):
        own = [np.frombuffer(x, "<u8") for x in data]
        return forest(sizes, folded([bitmap(x) for x in own]), labels, p, q, own)

    return settle(members, sets, connect)


def _classes(df: DataFrame, doc_id: str, text: str, words: int, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, node, size), and per node (node, first, n, component): component is a node."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def describe(texts):
        sets = [shingle_set(x, words) for x in texts]
        return [[node_of(x) for x in sets], [len(x) for x in sets], [bitmap(x) for x in sets]]

    prints = materialize(map_text(rows, "text", [("node", T.LongType()), ("size", T.LongType()), ("bitmap", T.BinaryType())], describe).drop("text"))
    mark = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = prints.groupBy("node").agg(F.min(mark).alias("first"), F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("text_hash"),
                                         F.max("size").alias("size"), F.max("bitmap").alias("bitmap"))
    classes = materialize(classes)
    found = components(links(rows.select("text_hash", "text"), classes.where("size > 0").select("node", "size", "bitmap", "text_hash"), words, similar))
    classes = classes.join(found, "node", "left").select("node", "first", "n", "size", F.coalesce("component", "node").alias("component"))
    return prints.select("doc_id", "text_hash", "node", "size"), classes


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable over links.

    NULL, empty and blank texts have the empty set and are linked with nothing, not even with each other: their component is
    their own doc_id. Rows that repeat a doc_id stay, each with its own text's set. Rows without doc_id belong to the component
    of their set, whose id is NULL if no row of it has one. An empty table gives an empty table; other columns are not read.
    """
    prints, classes = _classes(df, doc_id, text, words, similar)
    classes = materialize(classes)
    low = classes.groupBy("component").agg(F.min("first.doc_id").alias("low"), F.count(F.lit(1)).alias("classes"))
    of_class = join_summary(classes.select("node", "n", "component"), low, ["component"], "classes")
    found = join_summary(prints.select("doc_id", "node", "size"), of_class.select("node", "n", "low"), ["node"], "n")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row of each component of links, that of the smallest doc_id (rows without one come last); all columns of ``df``.

    NULL, empty and blank texts have one empty set and count as copies. Rows that repeat an id and text are one row
    afterwards; of different texts with one id the one with the smaller hash stays.
    """
    _, classes = _classes(df, doc_id, text, words, similar)
    kept = classes.groupBy("component").agg(F.min("first").alias("first"))
    own_id, own_hash, kept_id, kept_hash = fresh(df, "id", "hash", "kept_id", "kept_hash")
    kept = kept.select(F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash)).distinct()
    whole = df.withColumns({own_id: F.col(doc_id).cast("long"), own_hash: F.xxhash64(text)})
    same = F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash))
    return whole.join(kept, same, "left_semi").dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
