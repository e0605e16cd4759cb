"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. A letter trigram
is the product of its letters' vectors, shifted cyclically by two, one and no places; a text is the sum
of its trigrams. Texts are lower-cased, and a run of characters that are no letters counts as one
blank letter. A language's prototype is the sum over all its learning texts, and a text gets the
language whose prototype has the largest cosine with it.

Texts are handled in batches: trigrams are counted per text, the vectors of the batch's distinct
trigrams are built from the letters', and one matrix product bundles all texts of the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import fresh, map_text, small_batches, worker_state

DIMENSIONS = 512
SEED = 41
BATCH_TEXTS = 192
BATCH_CHARS = 1 << 19
GROUP = 2048  # languages that a pass compares with: their prototypes travel to every task, 4 KB each (16 KB with 2,048 dimensions)
UNKNOWN = "und"


class Letters:
    """Which code points are letters, and their random vectors."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.seen = np.zeros(0x110000, bool)
        self.place = np.zeros(0x110000, np.int64)
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) >= 1 << 14:
                self.vectors.clear()
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.vectors[code] = (2 * bits - 1).astype(np.int8)
        return self.vectors[code]


def letters(dimensions: int, seed: int) -> Letters:
    return worker_state(("letters", dimensions, seed), lambda: Letters(dimensions, seed))


def trigrams(texts: list[str], known: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of every trigram, its column, letters of every column as an n x 3 array of code points; 0 is the blank)."""
    joined = " " + "\n".join(x.lower().replace("\n", " ") for x in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    text_of = np.cumsum(codes == 10, dtype=np.int32)
    codes = np.where(known.letter[codes], codes, 0)
    kept = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]  # one blank for a run of them
    codes, text_of = codes[kept], text_of[kept]
    if len(codes) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, 3), np.int64)
    known.seen[codes] = True
    alphabet = np.flatnonzero(known.seen)
    known.seen[alphabet] = False
    known.place[alphabet] = np.arange(len(alphabet))
    small = known.place[codes]
    size = len(alphabet)
    keys = (small[:-2] * size + small[1:-1]) * size + small[2:]
    # a window around a blank between two texts belongs to neither; the blank after a text may stand for the next one's
    middle = codes[1:-1] != 0
    inside = middle | (text_of[:-2] == text_of[2:])
    of, keys = np.where(middle, text_of[1:-1], text_of[:-2])[inside], keys[inside]
    if size ** 3 <= 1 << 21:
        present = np.flatnonzero(np.bincount(keys, minlength=size ** 3))
        column = np.empty(size ** 3, np.int64)
        column[present] = np.arange(len(present))
        at = column[keys]
    else:
        present, at = np.unique(keys, return_inverse=True)
    return of, at, alphabet[np.stack([present // size // size, present // size % size, present % size], 1)]


def trigram_vectors(spelled: np.ndarray, known: Letters) -> np.ndarray:
    alphabet, at = np.unique(spelled, return_inverse=True)
    one = np.stack([known.vector(int(c)) for c in alphabet])
    at = at.reshape(spelled.shape)
    return np.roll(one, 2, axis=1)[at[:, 0]] * np.roll(one, 1, axis=1)[at[:, 1]] * one[at[:, 2]]


def bundles(of: np.ndarray, at: np.ndarray, spelled: np.ndarray, n: int, known: Letters) -> np.ndarray:
    """The vector of each of n texts (or groups of texts), as whole numbers in single or double precision."""
    columns = len(spelled)
    out = np.zeros((n, known.dimensions))
    if not columns:
        return out
    step = max(1, (1 << 22) // n)
    order = np.argsort(at, kind="stable") if columns > step else None
    for start in range(0, columns, step):
        stop = min(columns, start + step)
        if order is None:
            here, own = at, of
        else:
            rows = order[np.searchsorted(at, start, sorter=order):np.searchsorted(at, stop, sorter=order)]
            here, own = at[rows], of[rows]
        counts = np.bincount(own * (stop - start) + (here - start), minlength=n * (stop - start)).reshape(n, -1).astype(np.float32)
        for a in range(0, stop - start, 4096):
            out += counts[:, a:a + 4096] @ trigram_vectors(spelled[start + a:min(stop, start + a + 4096)], known).astype(np.float32)
    return out


def pieces(texts: list[str | None]):
    """Ranges of the list that hold a bounded number of texts and characters; one long text stands alone."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and (i - start >= BATCH_TEXTS or size + len(x or "") > BATCH_CHARS):
            yield start, i
            start, size = i, 0
        size += len(x or "")
    if texts:
        yield start, len(texts)


def learn(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of every language of ``df``; rows without text or language teach nothing.

    Every task adds up its texts, one vector per language; vectors are summed by component in Spark,
    and one vector per language reaches the driver. Any number of languages may be named.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    small_batches(df.sparkSession)

    def run(batches):
        known, sums = letters(dimensions, seed), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces(texts):
                names = sorted(set(langs[a:b]))
                of, at, spelled = trigrams(texts[a:b], known)
                group = np.array([names.index(x) for x in langs[a:b]])
                for name, vector in zip(names, bundles(group[of], at, spelled, len(names), known)):
                    sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)],
                                             names=["lang", "at", "value"])

    sums = rows.mapInArrow(run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    vectors: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        vectors.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["value"]
    return dict(sorted(vectors.items()))


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", out: str = "lang_pred", score: str = "score",
             dimensions: int = DIMENSIONS, seed: int = SEED, familiarity: str | None = None) -> DataFrame:
    """Add the language of the nearest prototype and its cosine, at least 0 and at most 1.

    ``familiarity`` names a third column: the mean product of the text's trigrams with that prototype, both at length 1.
    Unlike the cosine it does not grow with the text's length, so one limit serves short and long texts.

    ``und`` and 0 where the text is NULL or has no letter, or where there is no prototype. Ties go to the
    alphabetically first language. All rows and other columns stay. More than ``GROUP`` languages are compared in several passes.
    """
    names = sorted(prototypes)
    if len(names) > GROUP:
        return _in_groups(df, prototypes, text, out, score, dimensions, seed, familiarity)
    return _compared(df, prototypes, text, out, score, dimensions, seed, familiarity, 0.0)


def _in_groups(df, prototypes, text, out, score, dimensions, seed, familiarity):
    """The best of every group's best; the first of equal ones, as groups are in order."""
    names, rows, best = sorted(prototypes), df, []
    for start in range(0, len(names), GROUP):
        best.append(fresh(rows, "lang", "cosine", "mean"))
        lang, cosine, mean = best[-1]
        rows = _compared(rows, {n: prototypes[n] for n in names[start:start + GROUP]}, text, lang, cosine, dimensions, seed, mean, -1.0)
    top = F.lit(None)
    for lang, cosine, mean in best:
        found = F.struct(F.col(cosine).alias("cosine"), F.col(lang).alias("lang"), F.col(mean).alias("mean"))
        top = found if best[0][0] == lang else F.when(found["cosine"] > top["cosine"], found).otherwise(top)
    held = fresh(rows, "top")[0]
    rows = rows.withColumn(held, top)
    given = {out: F.col(held)["lang"], score: F.greatest(F.col(held)["cosine"], F.lit(0.0))} | ({familiarity: F.col(held)["mean"]} if familiarity else {})
    kept = [c for c in df.columns if c.lower() not in {g.lower() for g in given}]
    return rows.select(*kept, *[v.alias(c) for c, v in given.items()])


def _compared(df, prototypes, text, out, score, dimensions, seed, familiarity, least):
    """``identify`` in one pass; scores below ``least`` become it."""
    names = sorted(prototypes)
    profile = np.stack([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in names], 1) if names else np.zeros((dimensions, 0))

    def run(texts):
        known = letters(dimensions, seed)
        langs, scores, means = [], [], []
        for a, b in pieces(texts):
            part = [x or "" for x in texts[a:b]]
            of, at, spelled = trigrams(part, known)
            vectors = bundles(of, at, spelled, len(part), known)
            size = np.sqrt((vectors * vectors).sum(1))
            if not names:
                langs += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                means += [0.0] * len(part)
                continue
            cosine = vectors @ profile / np.where(size, size, 1.0)[:, None]
            best = cosine.argmax(1)
            has = [any(c.isalpha() for c in x) for x in part]
            langs += [names[i] if fine else UNKNOWN for i, fine in zip(best, has)]
            scores += [float(min(1.0, max(least, row[i]))) if fine else 0.0 for row, i, fine in zip(cosine, best, has)]
            count = np.maximum(np.bincount(of, minlength=len(part)), 1)
            mean = cosine[np.arange(len(part)), best] * size / (np.sqrt(dimensions) * count)
            means += [float(x) if fine else 0.0 for x, fine in zip(mean, has)]
        return [langs, scores, means][:len(added)]

    added = [(out, T.StringType()), (score, T.DoubleType())] + ([(familiarity, T.DoubleType())] if familiarity else [])
    return map_text(df, text, added, run, rows=2048)


def predict(docs: DataFrame, learning: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; prototypes come from the rows where ``learning`` holds."""
    prototypes = learn(docs.where(learning))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return identify(rows, prototypes).select("doc_id", "held_out", "lang_pred", "score")
