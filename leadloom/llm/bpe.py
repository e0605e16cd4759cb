"""Byte-pair encoding of whole texts, long ones by tree concatenation.

A text of up to ``leaf_chars`` characters is encoded where it is read. A longer one is halved until
its parts are that short, the parts are encoded as rows of their own on all executors, and neighbours
are joined pairwise up the tree: a window around each join is encoded again and grows until its
tokens agree with the left and the right part on one token each. What stands left of that token is
taken from the left part, what stands right from the right part, and the window fills the middle.

Why one common token is enough:

* Splitting into words scans from left to right and remembers nothing, so two scans that start a
  word at the same place go on alike. Parts and windows begin at letters: a scan that begins
  inside a run of letters ends its first word where the whole text's scan does.
* Within a word, merges happen in (rank, position) order, and no merge crosses the border of two
  final tokens. Hence a sequence is the encoding of a word exactly if every two neighbours in it
  are the encoding of the two together. A token that window and part share at the same place
  gives both of its neighbours such a partner.
* Parts begin at letters that never compose with what stands before them, so normal forms add up,
  and never inside a special token.

The vocabulary must mark word ends (suffix) and spell bytes as the byte-level alphabet does; a text
whose tokens cannot be joined this way is encoded whole. NULL texts encode like empty ones: no ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import arrow_schema, fresh, map_text, with_columns, worker_state

LEAF_CHARS = 32768
CACHED_WORDS = 250_000  # of one worker process, about 50 MB
FIRST_WINDOW = 64

# The letters, digits and spaces below U+0300, of which every character is its own normal form.
_LETTERS = "a-zªµºß-öø-ˁˆ-ˑˠ-ˤˬˮ"
_DIGITS = "0-9²³¹¼½¾"
_PLAIN = re.compile(r"[\t-\r -~¡-˿]*")
_CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"


class Words(dict):
    """The ids of every word met, as bytes; a word that is new is merged by the library's model."""

    def __init__(self, model):
        self.merge = model.tokenize
        # the byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [i for i in range(256) if i not in printing]
        self.spelling = {i: chr(i) for i in printing} | {i: chr(256 + k) for k, i in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
        ids = array("I", [token.id for token in self.merge(spelled)]).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """The tokenizers library with a cache of words. One per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        added = {t["id"]: t["content"] for t in described["added_tokens"]}
        suffix = described["model"].get("end_of_word_suffix") or ""
        size = max(vocabulary.values()) + 1
        self.text = [b""] * size
        self.size = np.zeros(size, np.int64)  # bytes of normalised text that a token stands for
        for token, i in vocabulary.items():
            self.text[i] = token.encode()
            ends = bool(suffix) and token.endswith(suffix)
            self.size[i] = len(token.encode()) if i in added else len(token) - len(suffix) * ends
        self.special = sorted(added.values())
        # the fast way holds for this word pattern only; any other vocabulary goes through the library as it is
        split = json.dumps(described.get("pre_tokenizer"))
        self.known = bool(suffix) and r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split
        self.split = re.compile(rf"[{_LETTERS}]+|{_CONTRACTIONS}|[{_DIGITS}]|[^\t-\r {_LETTERS}{_DIGITS}]+").findall
        self.words = Words(self.whole.model)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, word = self.split, self.words.__getitem__
        plain = [self.known and _PLAIN.fullmatch(x) is not None and not any(s in x for s in self.special) for x in texts]
        others = [x for x, easy in zip(texts, plain) if not easy]
        rest = iter([np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(others, add_special_tokens=False)]
                    if others else [])
        return [b"".join(map(word, split(x.lower()))) if easy else next(rest) for x, easy in zip(texts, plain)]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode([text])[0], "<u4")

    def decode(self, ids: bytes | None) -> bytes:
        """UTF-8 of ``decode(ids, skip_special_tokens=False)`` of a vocabulary without a decoder."""
        known = self.text
        if self.whole.decoder is not None:
            return self.whole.decode(np.frombuffer(ids or b"", "<u4").tolist(), skip_special_tokens=False).encode()
        return b" ".join([known[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


def codec(path: str) -> Codec:
    return worker_state(("codec", path), lambda: Codec(path))


def is_cut(char: str) -> bool:
    """Whether a part may begin with this letter: nothing before it can change it."""
    if char.isascii():
        return char.isalpha()
    jamo = "ᅠ" <= char <= "ᇿ" or "ힰ" <= char <= "퟿"
    return char.isalpha() and not jamo and unicodedata.normalize("NFC", char) == char


def inside(text: str, at: int, whole: list[str]) -> bool:
    """Whether ``at`` lies within one of these strings, which are tokens by themselves."""
    return any(text.find(x, max(0, at - len(x) + 1), at + len(x) - 1) >= 0 for x in whole)


def cut_at(text: str, at: int, whole: list[str], step: int = -1) -> int:
    """The next place from ``at`` on where a part may begin; the border of the text if there is none."""
    while 0 < at < len(text) and (not is_cut(text[at]) or inside(text, at, whole)):
        at += step
    return at


def halves(text: str, leaf_chars: int, whole: list[str], path: str = "") -> list[tuple[str, str]]:
    """(path in the tree, text) of each leaf from left to right; paths are strings of 0 and 1."""
    at = cut_at(text, len(text) // 2, whole) if len(text) > leaf_chars else 0
    if not at:
        return [(path, text)]
    return halves(text[:at], leaf_chars, whole, path + "0") + halves(text[at:], leaf_chars, whole, path + "1")


def _spans(codec: Codec, ids: np.ndarray, base: int) -> np.ndarray:
    ends = np.cumsum(codec.size[ids]) + base
    return np.stack([ends - codec.size[ids], ends, ids.astype(np.int64)], 1)


def _shared(one: np.ndarray, other: np.ndarray, last: bool) -> tuple[int, int] | None:
    """Rows of a token that both hold at the same place, the first or the last such."""
    where = {tuple(row): i for i, row in enumerate(one.tolist())}
    rows = other.tolist()
    for j in (range(len(rows) - 1, -1, -1) if last else range(len(rows))):
        i = where.get(tuple(rows[j]))
        if i is not None and rows[j][1] > rows[j][0]:
            return i, j
    return None


def join(codec: Codec, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
    """The encoding of two neighbours from their own, encoding only a window around the join again."""
    (a, of_a), (b, of_b) = left, right
    width = FIRST_WINDOW
    while True:
        start = cut_at(a, max(0, len(a) - width), codec.special)
        stop = cut_at(b, min(width, len(b)), codec.special, step=1)
        window = codec.ids(a[start:] + b[:stop])
        if start == 0 and stop == len(b):
            return a + b, window
        tail, head = codec.ids(a[start:]), codec.ids(b[:stop])
        border = int(codec.size[tail].sum())  # bytes of the window that the left part gives
        before = int(codec.size[of_a].sum()) - border
        middle = _spans(codec, window, 0)
        near_a = max(0, len(of_a) - 2 * len(tail) - 16)
        side_a = _spans(codec, of_a[near_a:], int(codec.size[of_a[:near_a]].sum()) - before)
        side_b = _spans(codec, of_b[:2 * len(head) + 16], border)
        in_a = (0, -1) if start == 0 else _shared(side_a, middle[middle[:, 1] <= border], last=False)
        in_b = (len(of_b), len(window)) if stop == len(b) else None
        if in_b is None:
            later = int(np.searchsorted(middle[:, 0], border))
            hit = _shared(side_b, middle[later:], last=True)
            in_b = hit and (hit[0], hit[1] + later)
        if in_a and in_b and in_a[1] < in_b[1]:
            kept = of_a[:0] if start == 0 else of_a[:near_a + in_a[0] + 1]
            return a + b, np.concatenate([kept, window[in_a[1] + 1:in_b[1]], of_b[in_b[0]:]]).astype("<u4")
        width *= 2


def join_tree(codec: Codec, leaves: dict[str, tuple[str, np.ndarray]]) -> np.ndarray:
    """Join the leaves of one text, deepest first."""
    nodes = dict(leaves)
    for depth in range(max(map(len, nodes)), 0, -1):
        for path in sorted(p for p in nodes if len(p) == depth and p[-1] == "0"):
            parent = path[:-1]
            nodes[parent] = join(codec, nodes.pop(path), nodes.pop(parent + "1"))
    return nodes[""][1]


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", leaf_chars: int = LEAF_CHARS,
           decoded: str | None = None) -> DataFrame:
    """Add ``out``: the ids of the whole text as little-endian unsigned 32-bit integers, in binary.

    ``tokenizer`` is a path of a tokenizer file that every executor can read. Every row stays, repeated
    rows included; NULL and empty texts get an empty value. All other columns
    pass through; one named ``out`` is replaced. With ``decoded`` a column of that name gets the text that
    the ids decode to, special tokens included, in the same step.
    """
    def whole(texts):
        known = codec(tokenizer)
        ids = known.encode([x or "" for x in texts])
        return [ids, _texts(known, ids)] if decoded else [ids]

    added = [(out, T.BinaryType())] + ([(decoded, T.StringType())] if decoded else [])
    is_long = F.coalesce(F.length(text) > leaf_chars, F.lit(False))
    short = map_text(df.where(~is_long), text, added, whole)
    return short.unionByName(_encode_long(df.where(is_long), tokenizer, text, out, leaf_chars, decoded).select(*short.columns))


def _texts(known: Codec, ids: list[bytes | None]) -> pa.Array:
    return pa.array([known.decode(x) for x in ids], pa.binary()).cast(pa.string())


def _encode_long(df: DataFrame, tokenizer: str, text: str, out: str, leaf_chars: int, decoded: str | None) -> DataFrame:
    """Leaves as rows; the row's other columns travel with its first leaf."""
    row, path, piece, of_piece = fresh(df, "row", "path", "piece", "piece_ids")
    df = df.withColumn(row, F.monotonically_increasing_id())
    # later leaves of a row hold nothing else, so no column is required here
    leaf_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name.lower() != text.lower()]
                               + [T.StructField(path, T.StringType()), T.StructField(piece, T.StringType())])
    kinds = arrow_schema(leaf_schema)

    def split(batches):
        for batch in batches:
            at = next(i for i, name in enumerate(batch.schema.names) if name.lower() == text.lower())
            for k in range(batch.num_rows):
                leaves = halves(batch.column(at)[k].as_py(), leaf_chars, codec(tokenizer).special)
                columns = []
                for field in kinds:
                    if field.name in (path, piece):
                        columns.append(pa.array([leaf[field.name == piece] for leaf in leaves], field.type))
                        continue
                    own = batch.column(batch.schema.get_field_index(field.name)).slice(k, 1)
                    more = own.take(pa.array([0] * (len(leaves) - 1), pa.int32())) if field.name == row else pa.nulls(len(leaves) - 1, own.type)
                    columns.append(pa.concat_arrays([own, more]))
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    def encode_leaves(texts):
        return [codec(tokenizer).encode(texts)]

    leaves = df.mapInArrow(split, leaf_schema).repartition(row, path)
    leaves = map_text(leaves, piece, [(of_piece, T.BinaryType())], encode_leaves, rows=64)
    schema = with_columns(df.drop(row), [(text, T.StringType()), (out, T.BinaryType())] + ([(decoded, T.StringType())] if decoded else []))

    def assemble(group):
        group = group.sort_by(path)
        paths, pieces = group.column(path).to_pylist(), group.column(piece).to_pylist()
        ids = [np.frombuffer(x, "<u4") for x in group.column(of_piece).to_pylist()]
        known = codec(tokenizer)
        joined = join_tree(known, dict(zip(paths, zip(pieces, ids))))
        made = {text.lower(): pa.array(["".join(pieces)], pa.string()), out.lower(): pa.array([joined.astype("<u4").tobytes()], pa.binary())}
        if decoded:
            made[decoded.lower()] = _texts(known, made[out.lower()].to_pylist())
        return pa.table({f.name: made.get(f.name.lower()) if f.name.lower() in made else group.column(f.name).slice(0, 1) for f in schema.fields})

    return leaves.groupBy(row).applyInArrow(assemble, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the ids, special tokens included. NULL ids decode to an empty text."""
    def texts(values):
        return [_texts(codec(tokenizer), values)]

    return map_text(df, ids, [(out, T.StringType())], texts, rows=64)


def digests(docs: DataFrame, tokenizer: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents."""
    return encode(docs.select("doc_id", "text"), tokenizer, leaf_chars=leaf_chars, decoded="decoded").select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
