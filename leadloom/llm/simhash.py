"""SimHash fingerprints and their near-duplicate components by a trie self-join.

Fingerprints: words and shingles are slices of one byte string per text; a bit is set where more than
half of the shingles' hashes set it.

Links: fingerprints within ``distance`` bits agree in at least one of ``distance + 1`` blocks of bits.
Per block, equal values bring fingerprints together, and there a sorted array of the fingerprints,
rotated so that the block leads, is a binary trie: a node is a range of it. Pairs of nodes are
traversed together from the root down, one bit at a time; the bits in which their paths differ add
up, and a pair is dropped when the budget is exceeded, or when all below both is connected already. The first
steps down are Spark's where a group is large: its nodes some bits down are counted off, and every pair of them within the budget
is a row group of its own, dealt to any task. Only distinct fingerprints enter, so exact
copies cost nothing, and a group hands on a spanning forest of its links instead of all of them.

Components: ``graphs.components`` over fingerprints; the smallest document of a fingerprint stands for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.graphs import components, contracted
from leadloom.llm.common import fresh, map_text, whole_groups
from leadloom.scale import join_summary
from leadloom.session import materialize

WORDS = 4
DISTANCE = 4
BITS = 64
SEED = 42
DIRECT = 64  # node pairs of up to so many fingerprint pairs are compared one by one
STEP = 1 << 16  # node pairs in hand at once
GROUP = 1 << 16  # fingerprints of a node pair's side that a task gets, about; more are split by further bits
MOST_SPLIT = 12  # bits


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> list[int]:
    """Hash of every shingle, repeats included: one for a text of fewer words, none for a text without words."""
    clean = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes: A-Z and ASCII white space only
    if not clean:
        return []
    blanks = np.flatnonzero(np.frombuffer(clean, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(blanks) < words:
        return [digest(clean, seed)]
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(clean)]
    return [digest(clean[a:b], seed) for a, b in zip(starts, ends[words - 1:])]


def fingerprints(texts: list[str | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints; zero for a text without words."""
    hashes = [shingle_hashes(x, words, seed) for x in texts]
    sizes = np.array([len(x) for x in hashes])
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    for at in full.tolist():
        ones = np.zeros(BITS, np.int64)
        own = np.array(hashes[at], np.uint64)
        for start in range(0, len(own), 1 << 16):
            octets = own[start:start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
        out[at] = np.packbits(2 * ones > len(own)).view(">u8")[0]
    return out


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """Add the fingerprint as a signed 64-bit integer. NULL, empty and blank texts get 0, linked like any other."""
    def run(texts):
        return [pa.array(fingerprints(texts, words).view(np.int64))]

    return map_text(df, text, [(out, T.LongType())], run)


def block_bounds(distance: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each block, from the highest bit down."""
    edges = [BITS * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def rotated(values: np.ndarray, bits: int) -> np.ndarray:
    return values if bits == 0 else (values << np.uint64(bits)) | (values >> np.uint64(BITS - bits))


def trie_pairs(keys: np.ndarray, pairs: list[tuple[int, int, int, int, int, int]], distance: int, labels: np.ndarray | None = None):
    """Positions of linked keys below node pairs: (range, range, next bit, bits that differ so far), a node with itself included.

    ``keys`` are sorted within each range. Yields arrays (left, right). The caller may keep ``labels`` of what is connected up to date:
    pairs of nodes all below which have one label are dropped. Node pairs go down the tries together, deepest first.
    """
    start = np.array(pairs, np.int64).reshape(-1, 6)
    start = start[(start[:, 0] != start[:, 2]) | (start[:, 1] - start[:, 0] > 1)]
    stack = [start]
    while stack:
        pairs = stack.pop()
        if len(pairs) > STEP:
            stack += [pairs[STEP:], pairs[:STEP]]
            continue
        if labels is not None and len(pairs):
            changes = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
            a, b, c, d = pairs[:, :4].T
            one = (changes[b - 1] == changes[a]) & (changes[d - 1] == changes[c]) & (labels[a] == labels[c])
            pairs = pairs[~one]
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (sizes <= DIRECT) | (pairs[:, 4] >= BITS)
        if small.any():
            yield from _compare(keys, pairs[small], distance)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        one = _split(keys, pairs[:, 0], pairs[:, 1], pairs[:, 4])
        other = _split(keys, pairs[:, 2], pairs[:, 3], pairs[:, 4])
        a, b, c, d, bit, differ = pairs.T
        same = (a == c) & (b == d)  # a node with itself: its two children meet once
        made = [np.column_stack([a, one, c, other, bit + 1, differ]), np.column_stack([one, b, other, d, bit + 1, differ]),
                np.column_stack([a, one, other, d, bit + 1, differ + 1]),
                np.column_stack([one, b, c, other, bit + 1, differ + 1])[~same]]
        made = np.concatenate(made)
        made = made[(made[:, 0] < made[:, 1]) & (made[:, 2] < made[:, 3]) & (made[:, 5] <= distance)]
        made = made[~((made[:, 0] == made[:, 2]) & (made[:, 1] == made[:, 3]) & (made[:, 1] - made[:, 0] == 1))]
        # what is nearest is looked at first: it connects most
        stack += [x for x in (made[made[:, 5] > 0], made[made[:, 5] == 0]) if len(x)]


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the ones of this bit begin in each range: a binary search in all ranges at once."""
    shift = (BITS - 1 - bit).astype(np.uint64)
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        zero = (keys[np.minimum(middle, len(keys) - 1)] >> shift) & np.uint64(1) == 0
        low = np.where(open_ & zero, middle + 1, low)
        high = np.where(open_ & ~zero, middle, high)
    return low


def _compare(keys, pairs, distance):
    """Compare all keys of the left range with all of the right one."""
    width, across = pairs[:, 3] - pairs[:, 2], (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    of = np.repeat(np.arange(len(pairs)), across)
    at = np.arange(len(of)) - np.repeat(np.cumsum(across) - across, across)
    left, right = pairs[of, 0] + at // width[of], pairs[of, 2] + at % width[of]
    fine = np.where(pairs[of, 0] == pairs[of, 2], left < right, True)
    left, right = left[fine], right[fine]
    near = np.bitwise_count(keys[left] ^ keys[right]) <= distance
    if near.any():
        yield left[near], right[near]


def connected(keys: np.ndarray, pairs: list[tuple[int, int, int, int, int, int]], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the linked keys: every position but the first of its component, and that one."""
    labels = np.arange(len(keys))
    for left, right in trie_pairs(keys, pairs, distance, labels):
        # links between what is apart so far; smallest labels spread over them, then over all of each label
        one, other = labels[left], labels[right]
        apart = one != other
        if apart.any():
            moved, to = contracted(one[apart], other[apart])
            at = np.searchsorted(moved, labels)
            hit = (at < len(moved)) & (moved[np.minimum(at, len(moved) - 1)] == labels)
            labels[hit] = to[at[hit]]
    fine = np.flatnonzero(labels != np.arange(len(keys)))
    return fine, labels[fine]


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of nodes (node, fingerprint), fingerprints distinct: a spanning forest of the links of every node pair dealt out.

    There are at most ``distance + 1`` times 2^(bits of a block) groups, so their counts may travel to every task.
    """
    bounds = block_bounds(distance)
    unsigned = [F.struct(F.lit(i).alias("block"), (F.shiftrightunsigned("fingerprint", BITS - first - size).bitwiseAND(F.lit((1 << size) - 1))).alias("value"))
                for i, (first, size) in enumerate(bounds)]
    dealt = nodes.select("node", "fingerprint", F.explode(F.array(*unsigned)).alias("at")).select("node", "fingerprint", "at.block", "at.value")
    counts = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    more = F.least(F.greatest(F.ceil(F.log2(F.col("n") / GROUP)), F.lit(0)), F.lit(MOST_SPLIT)).cast("int")
    split = counts.select(F.col("block").alias("of"), F.col("value").alias("with"), more.alias("split"))
    dealt = dealt.join(F.broadcast(split), (F.col("block") == F.col("of")) & (F.col("value") == F.col("with"))).drop("of", "with")
    # the bits behind the block, cyclically, say which node below the block's a fingerprint is in
    after = F.element_at(F.array(*[F.lit((first + size) % BITS) for first, size in bounds]), F.col("block") + 1)
    turned = F.call_function("shiftleft", F.col("fingerprint"), after).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fingerprint"), F.lit(BITS) - after))
    turned = F.when(after == 0, F.col("fingerprint")).otherwise(turned)
    child = F.when(F.col("split") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", turned, F.lit(BITS) - F.col("split")))
    dealt = dealt.withColumn("child", child)
    every = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("split")) - 1)
    near = F.filter(every, lambda c: F.bit_count(c.bitwiseXOR(F.col("child"))) <= distance)
    pair = F.explode(F.when(F.col("split") == 0, F.array(F.lit(0).cast("long"))).otherwise(near))
    dealt = dealt.select("node", "fingerprint", "block", "value", "split", "child", pair.alias("mate"))
    dealt = dealt.select("node", "fingerprint", F.col("block").cast("long").alias("block"), "value", F.least("child", "mate").alias("low"), F.greatest("child", "mate").alias("high"),
                         F.col("split").cast("long").alias("split"), "child")
    place = ["block", "value", "low", "high"]
    dealt = dealt.repartition(*place).sortWithinPartitions(*place)

    def run(batches):
        for rows, edges in whole_groups(batches, place):
            column = {name: rows.column(name).to_numpy() for name in (*place, "node", "fingerprint", "split", "child")}
            keys = column["fingerprint"].view(np.uint64).copy()
            for b in np.unique(column["block"]).tolist():
                of = column["block"] == b
                keys[of] = rotated(keys[of], bounds[b][0])
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            order = np.lexsort((keys, column["child"], group))
            keys, own, child = keys[order], column["node"][order], column["child"][order]
            pairs = []
            for i, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                low, high, split = (int(column[name][a]) for name in ("low", "high", "split"))
                bit = bounds[int(column["block"][a])][1] + split
                middle = a + int(np.searchsorted(child[a:z], high)) if low != high else z
                if low == high:
                    pairs.append((a, z, a, z, bit, 0))
                elif a < middle < z:
                    pairs.append((a, middle, middle, z, bit, (low ^ high).bit_count()))
            if pairs:
                left, right = connected(keys, pairs, distance)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(own[left]), pa.array(own[right])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _classified(df: DataFrame, doc_id: str, text: str, distance: int, words: int) -> DataFrame:
    """doc_id, text_hash, fingerprint, component (a fingerprint) and component_id of every row."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    prints = materialize(add_fingerprint(rows, "text", words=words).select("doc_id", "text_hash", "fingerprint"))
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # ids may repeat or be NULL, so a fingerprint and not its first document is the node
    found = components(links(classes.select(F.col("fingerprint").alias("node"), "fingerprint"), distance))
    classes = classes.join(found, classes["fingerprint"] == found["node"], "left").select(
        "fingerprint", "n", "first", F.coalesce("component", "fingerprint").alias("component"))
    low = classes.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    of_class = join_summary(classes, low, ["component"], "classes")
    return join_summary(prints, of_class.select("fingerprint", "n", "component", "component_id"), ["fingerprint"], "n")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Rows that repeat a doc_id stay, each with its own text's fingerprint. Rows without doc_id belong to
    the component of their fingerprint, whose id is NULL if no row of it has one.
    """
    return _classified(df, doc_id, text, distance, words).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """One row of each component, that of the smallest doc_id (rows without one come last); all columns of ``df``.

    Rows that repeat an id and text are one row afterwards; of different texts with one id the one with
    the smaller hash stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = _classified(df, doc_id, text, distance, words).groupBy("component").agg(first)
    own_id, own_hash, kept_id, kept_hash = fresh(df, "id", "hash", "kept_id", "kept_hash")
    kept = kept.select(F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash)).distinct()
    rows = df.withColumns({own_id: F.col(doc_id).cast("long"), own_hash: F.xxhash64(text)})
    same = F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash))
    return rows.join(kept, same, "left_semi").dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
