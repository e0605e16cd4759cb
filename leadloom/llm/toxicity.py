"""Toxicity: a factorization machine over hashed terms.

The terms of a text are its lower-cased words and the beginnings of four, five and six letters of its
longer words, hashed to one of ``PLACES`` places; a place counts once a text, with a value that falls with the share of learning texts that have it
and is damped where very few have it, so a rare insult counts and a thousand unique words do not drown the rest. A
text's values have the length ``LENGTH``. Besides a weight every place has a short vector,
and the product of two places' vectors is the weight of their meeting, which an additive model misses.
Every term of every learning text enters; places that no learning text has say nothing. Weights are learnt by FTRL-Proximal and vectors by adaptive
gradients, in slices of the sample whose states are averaged after every round. A vector near zero of a place without weight
is set to zero.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import map_text, worker_state
from leadloom.llm.hashed import CACHED_TOKENS, each_slice, sample, sigmoid, sliced

FACTORS = 4
ROUNDS = 6
BITS = 17
PLACES = 1 << BITS
DAMPING, LEAST_DAMPING = 0.003, 2.0  # share of the learning texts, and number of texts at least, at which a place has half its value
LENGTH = 10.0
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1.0, 0.1
RATE, SHRINK, START = 0.05, 1e-3, 0.02
POSITIVE = 2.0  # how much a text of label 1 counts
LEAST_VECTOR = 0.1
THRESHOLD = 0.5
WORD = r"[^\W\d_]+"


class Terms(dict):
    """For every word the bytes of its terms' places."""

    def __init__(self):
        self.split = re.compile(WORD).findall

    def __missing__(self, word: str) -> bytes:
        parts = [word] + [word[:n] + "~" for n in (4, 5, 6) if len(word) > n]
        found = b"".join((xxhash.xxh64_intdigest(x) >> (64 - BITS)).to_bytes(4, "little") for x in parts)
        if len(word) <= 64:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[word] = found
        return found

    def raw(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split((text or "").lower())))

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct places of a text, ascending."""
        return np.unique(np.frombuffer(self.raw(text), "<i4"))


def values(idf: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = idf[at]
    return found * (LENGTH / (np.sqrt((found * found).sum()) or 1.0))


def machine(bias: float, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> float:
    """Of the places of one text, whose weights, vectors and values are given."""
    weighted = v * x[:, None]
    total = weighted.sum(0)
    return bias + float(w @ x) + 0.5 * float(total @ total - (weighted * weighted).sum())


@dataclass
class Model:
    bias: float
    idf: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def value(self, at: np.ndarray) -> float:
        return machine(self.bias, self.weights[at], self.vectors[at], values(self.idf, at))

    def values_of(self, of: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """``value`` of n texts at once: ``of`` says which text a place belongs to."""
        x = self.idf[at]
        size = np.sqrt(np.bincount(of, x * x, n))
        x = x * (LENGTH / np.where(size, size, 1.0))[of]
        weighted = self.vectors[at] * x[:, None]
        out = self.bias + np.bincount(of, self.weights[at] * x, n) - 0.5 * np.bincount(of, (weighted * weighted).sum(1), n)
        for column in weighted.T:
            out += 0.5 * np.bincount(of, column, n) ** 2
        return out


def text_shares(rows: DataFrame) -> np.ndarray:
    """The value of every place before a text's length: how rare it is among the learning texts (``ready``: places of each)."""
    def count(batches):
        held = np.zeros(PLACES, np.int64)
        for batch in batches:
            for x in batch.column(0):
                held[np.frombuffer(x.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["place", "n"])

    counted = rows.select("places").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(PLACES)
    n[counted["place"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    texts = max(rows.count(), 2)
    half = max(LEAST_DAMPING, DAMPING * texts)
    return np.where(n > 0, np.log(texts / np.maximum(n, 1)) / np.log(texts) * n / (n + half), 0.0)


def weights(z: np.ndarray, n: np.ndarray, l1: float = L1, l2: float = L2) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))


def epoch(rows, idf: np.ndarray, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One pass over (places, label). The bias comes last in z and n; it has no vector and is not regularised."""
    z, n, v, g = (state[k].astype(np.float64) for k in "znvg")
    for at, label in rows:
        x, w, own = values(idf, at), weights(z[at], n[at]), v[at]
        bias = float(weights(z[-1], n[-1], 0.0, 0.0))
        error = (float(sigmoid(machine(bias, w, own, x))) - label) * (POSITIVE if label else 1.0)
        weighted = own * x[:, None]
        gradient = error * x[:, None] * (weighted.sum(0) - weighted) + SHRINK * own
        g[at] += gradient * gradient
        v[at] = own - RATE * gradient / np.sqrt(g[at])
        gradient = error * x
        z[at] += gradient - (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA * w
        n[at] += gradient * gradient
        z[-1] += error - (np.sqrt(n[-1] + error * error) - np.sqrt(n[-1])) / ALPHA * bias
        n[-1] += error * error
    return dict(z=z, n=n, v=v, g=g)


def _round(idf: np.ndarray, state: dict[str, np.ndarray], turn: int):
    def train(group):
        group = group.sort_by("doc_id")
        order = np.random.default_rng([turn, group.num_rows]).permutation(group.num_rows).tolist()
        at, labels = group.column("places"), group.column("label")
        after = epoch(((np.frombuffer(at[i].as_buffer(), "<i4"), labels[i].as_py()) for i in order), idf, state)
        return pa.table({"rows": pa.array([group.num_rows], pa.int64())}
                        | {k: pa.array([after[k].astype("<f4").tobytes()], pa.binary()) for k in "znvg"})

    return train


def learn(rows: DataFrame, rounds: int = ROUNDS, factors: int = FACTORS, seed: int = 77) -> Model:
    """A model from rows of (doc_id, text, label, slice); an empty one, which scores one half, if there are none."""
    def featurise(batches):
        terms = worker_state(("terms", BITS), Terms)
        for batch in batches:
            found = [terms(x).astype("<i4").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                                             names=["slice", "doc_id", "label", "places"])

    ready = sliced(rows.select("slice", "doc_id", "label", "text").mapInArrow(featurise, "slice int, doc_id long, label double, places binary"))
    idf = text_shares(ready)
    state = {"z": np.zeros(PLACES + 1), "n": np.zeros(PLACES + 1), "v": np.random.default_rng(seed).normal(0, START, (PLACES, factors)),
             "g": np.ones((PLACES, factors))}
    state = {k: x.astype(np.float32) for k, x in state.items()}
    for turn in range(rounds):
        states = each_slice(ready, _round(idf, state, turn), "rows long, z binary, n binary, v binary, g binary").collect()
        total = sum(s["rows"] for s in states)
        if not total:
            break
        states.sort(key=lambda s: bytes(s["z"]))
        state = {k: sum(np.frombuffer(s[k], "<f4") * (s["rows"] / total) for s in states).astype(np.float32).reshape(state[k].shape)
                 for k in "znvg"}
    z, n, v = (state[k].astype(np.float64) for k in "znv")
    w = weights(z, n)[:-1]
    kept = (w != 0) | (np.sqrt((v * v).sum(1)) >= LEAST_VECTOR)
    return Model(float(weights(z[-1], n[-1], 0.0, 0.0)), idf, w, v * kept[:, None])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1; a text without known terms, or NULL, gets that of the bias alone. Texts are scored a batch at a time."""
    small = Model(model.bias, model.idf.astype(np.float32), model.weights.astype(np.float32), model.vectors.astype(np.float32))

    def run(texts):
        terms = worker_state(("terms", BITS), Terms)
        raw = [terms.raw(x) for x in texts]
        of = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in raw])
        both = np.unique((of << BITS) | np.frombuffer(b"".join(raw), "<i4"))
        return [sigmoid(small.values_of(both >> BITS, both & (PLACES - 1), len(texts))).tolist()]

    return map_text(df, text, [(out, T.DoubleType())], run, rows=64)


def train(docs: DataFrame, labels: DataFrame, learning, label: str = "toxic") -> Model:
    return learn(sample(docs, labels, label, learning))
