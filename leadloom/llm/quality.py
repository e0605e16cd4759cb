"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are one- and two-word n-grams, hashed into 2**BITS places, each with its share of the text's
n-grams as value; a word that repeats the one before is written as a repeat mark. Training runs
FTRL-Proximal over a bounded sample in slices, one task each; after every round the slices' states are
averaged, and the next round goes on from there. A score is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadloom.llm.common import map_text, worker_state
from leadloom.llm.hashed import Tokens, each_slice, sample, sigmoid, sliced

BITS = 17
ROUNDS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
SCALE = 10.0  # of the shares
THRESHOLD = 0.3
REPEAT = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


def ngrams(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of all n-grams of a text, repeats included; the last place is the bias and never hashed to."""
    if not len(tokens):
        return np.empty(0, np.int64)
    words = tokens.copy()
    words[1:][tokens[1:] == tokens[:-1]] = np.uint64(REPEAT)
    pairs = words[:-1] * np.uint64(3) + (words[1:] ^ (words[1:] >> np.uint64(29)))
    both = np.concatenate([words, pairs]) * np.uint64(MIX)
    both ^= both >> np.uint64(32)
    return ((both * np.uint64(MIX)) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    places = ngrams(tokens(text or ""))
    at, counts = np.unique(places, return_counts=True)
    return at, SCALE * counts / max(1, len(places))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state: zero where the accumulated gradient stays below L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def epoch(rows, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of FTRL-Proximal over (places, values, label)."""
    z, n = z.astype(np.float64), n.astype(np.float64)
    bias = len(z) - 1
    for at, values, label in rows:
        at, values = np.append(at, bias), np.append(values, 1.0)
        w = weights(z[at], n[at])
        gradient = (sigmoid(float(w @ values)) - label) * values
        step = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA
        z[at] += gradient - step * w
        n[at] += gradient * gradient
    return z, n


def _round(z: np.ndarray, n: np.ndarray, turn: int):
    """One epoch of a slice from the common state, in an order that depends on nothing but the round."""
    def train(group):
        group = group.sort_by("doc_id")
        order = np.random.default_rng([turn, group.num_rows]).permutation(group.num_rows).tolist()
        at, values, labels = (group.column(c) for c in ("places", "shares", "label"))
        rows = ((np.frombuffer(at[i].as_buffer(), "<i4"), np.frombuffer(values[i].as_buffer(), "<f4"), labels[i].as_py()) for i in order)
        after = epoch(rows, z, n)
        return pa.table({"rows": pa.array([group.num_rows], pa.int64())}
                        | {name: pa.array([x.astype("<f4").tobytes()], pa.binary()) for name, x in zip("zn", after)})

    return train


def learn(rows: DataFrame, rounds: int = ROUNDS, bits: int = BITS) -> np.ndarray:
    """Weights from rows of (doc_id, text, label, slice); zero everywhere if there are none."""
    def featurise(batches):
        tokens = worker_state(("tokens",), Tokens)
        for batch in batches:
            for row in batch.to_pylist():
                at, values = features(row["text"], tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["slice"]], pa.int32()), pa.array([row["doc_id"]], pa.int64()), pa.array([row["label"]], pa.float64()),
                     pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([values.astype("<f4").tobytes()], pa.binary())],
                    names=["slice", "doc_id", "label", "places", "shares"])

    ready = sliced(rows.select("slice", "doc_id", "label", "text").mapInArrow(
        featurise, "slice int, doc_id long, label double, places binary, shares binary"))
    z = n = np.zeros((1 << bits) + 1, np.float32)
    for turn in range(rounds):
        states = each_slice(ready, _round(z, n, turn), "rows long, z binary, n binary").collect()
        total = sum(s["rows"] for s in states)
        if not total:
            break
        states.sort(key=lambda s: bytes(s["z"]))
        z, n = (sum(np.frombuffer(s[c], "<f4") * (s["rows"] / total) for s in states).astype(np.float32) for c in "zn")
    return weights(z, n).astype(np.float32)


def score(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1; a text without tokens, or NULL, gets that of the bias alone."""
    model = model.astype(np.float64)

    def run(texts):
        tokens = worker_state(("tokens",), Tokens)
        found = []
        for x in texts:
            places = ngrams(tokens(x or ""))
            found.append(model[-1] + SCALE * (model[places].sum() / len(places) if len(places) else 0.0))
        return [sigmoid(np.array(found, np.float64)).tolist()]

    return map_text(df, text, [(out, T.DoubleType())], run)


def train(docs: DataFrame, labels: DataFrame, learning, label: str = "quality") -> np.ndarray:
    return learn(sample(docs, labels, label, learning))
