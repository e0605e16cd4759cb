"""Conversation structure repair: the cheapest edits that make turns alternate, by alignment with the grammar's strings.

A conversation's role initials shall read ``(s?(ua)+)?``. A turn can be kept (cost 0), get another role (1) or be deleted (2; blank and
repeated turns must be), and empty turns can be inserted (5); turns that break off cost 5 unless deleted. Wagner-Fischer:
turns are aligned with the alternating string of each feasible length. Strings of all lengths end alike, so one table of
suffixes, turns by symbols still to come, aligns with all of them. Ukkonen: a greedy repair bounds the cost; a cell whose surplus of turns or symbols alone
would exceed that bound is not filled. Lengths of least cost are traced back, each to its audit (the
edits' initials D, I, K, R) that comes first in ASCII order, and the first of those audits is taken.

Conversations of any length: turns (without texts) are sorted over range partitions, so a long conversation lies in several. Each
partition cuts it into segments and aligns a segment with every string that the grammar allows between two of its
states (nothing yet, after s, after u, after a); costs and audits of neighbouring segments add up, within a partition first, then over the few
partitions of a conversation. Equal turns in a row are one turn with a number of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.common import small_batches
from leadloom.scale import join_summary
from leadloom.session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # what a prefix of the grammar's strings ends with
INITIALS = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
LEGAL = ("su", "ua", "au")
SEGMENT = 256  # turns that are aligned in one table
NEVER = 1 << 40
FREE, FORCED, BROKEN = range(3)  # faults of a turn: none, must be deleted, breaks off


def greedy(symbols: list[int], faults: list[int], expected: int) -> int:
    """Cost of a plain repair from left to right beyond the least cost of the turns, which bounds all that ends in u or a."""
    cost, free = 0, [s for s, f in zip(symbols, faults) if f == FREE]
    for i, symbol in enumerate(free):
        if symbol != expected:
            if i + 1 < len(free) and free[i + 1] == expected:
                cost += DELETE
                continue
            cost += REROLE
        expected = USER + ASSISTANT - expected
    return cost + 2 * INSERT  # one symbol more or less at the end, one where all are gone


def suffixes(symbols: np.ndarray, faults: np.ndarray, copies: np.ndarray, last: int, slack: int) -> np.ndarray:
    """Least cost of turns i.. against the last r symbols of an alternating string that ends in ``last``; rows i, columns r.

    Cells that a bound of ``slack`` beyond the turns' least costs excludes are ``NEVER``.
    """
    n = len(symbols)
    more = DELETE * (copies - 1)
    gone = DELETE * copies
    kept = np.where(faults == BROKEN, TRUNCATED, 0) + more
    usable = np.concatenate([np.cumsum((faults != FORCED)[::-1])[::-1], [0]])
    free = np.concatenate([np.cumsum((faults == FREE)[::-1])[::-1], [0]])
    width = usable[0] + slack // INSERT + 2
    wanted = np.where(np.arange(width) % 2 == 1, last, USER + ASSISTANT - last)  # the first of the last r symbols
    table = np.full((n + 1, width), NEVER, np.int64)
    right = min(width - 1, slack // INSERT)
    table[n, :right + 1] = INSERT * np.arange(right + 1)
    for i in range(n - 1, -1, -1):
        # fewer symbols than free turns left: each one less costs a deletion; more than usable turns: each one more an insertion
        low, high = max(0, free[i] - slack // DELETE), min(width - 1, usable[i] + slack // INSERT)
        row = table[i + 1, low:high + 1] + gone[i]
        if faults[i] != FORCED:
            first = max(low, 1)
            found = table[i + 1, first - 1:high] + kept[i] + np.where(wanted[first:high + 1] == symbols[i], 0, REROLE)
            row[first - low:] = np.minimum(row[first - low:], found)
        climb = INSERT * np.arange(high - low + 1)
        table[i, low:high + 1] = np.minimum.accumulate(row - climb) + climb
    table[table >= NEVER] = NEVER
    return table


def trace(table: np.ndarray, symbols, faults, copies, last: int, i: int, r: int) -> str:
    """The first audit in ASCII order among the cheapest of turns i.. against the last r symbols."""
    out, n = [], len(symbols)
    while i < n or r:
        cost = table[i, r]
        if i < n and table[i + 1, r] + DELETE * copies[i] == cost:
            out.append("D" * copies[i])
            i += 1
        elif r and table[i, r - 1] + INSERT == cost:
            out.append("I")
            r -= 1
        else:
            wanted = last if r % 2 else USER + ASSISTANT - last
            out.append(("K" if symbols[i] == wanted else "R") + "D" * (copies[i] - 1))
            i, r = i + 1, r - 1
    return "".join(out)


def align(symbols: list[int], faults: list[int], copies: list[int], pairs) -> dict[tuple[int, int], tuple[int, str]]:
    """Least cost and first audit of a segment for each wanted pair of states that it can lead between.

    ``symbols``: role initials as states, 0 for others.
    """
    n = len(symbols)
    s, f, c = np.array(symbols, np.int64), np.array(faults, np.int64), np.array(copies, np.int64)
    all_gone = int(DELETE * c.sum()), "D" * int(c.sum())
    systems = np.flatnonzero((s == SYSTEM) & (f != FORCED)).tolist()
    slack = max(greedy(symbols, faults, x) for x in (USER, ASSISTANT))
    tables = {last: suffixes(s, f, c, last, slack) for last in {x for _, x in pairs if x >= USER}}
    before = np.concatenate([[0], np.cumsum(DELETE * c)])
    keeping = np.where(f == BROKEN, TRUNCATED, 0) + DELETE * (c - 1)
    out = {}
    for entry, end in pairs:
        best, found = NEVER, []  # found: pairs of a kept first system turn (or none) and a number of symbols
        if end == entry:
            best, found = all_gone[0], [(None, 0)]
        if end == SYSTEM and entry == START:
            costs = [(int(before[n] - DELETE * c[i] + keeping[i]), i) for i in systems]
            best = min((x for x, _ in costs), default=NEVER)
            out_audits = ["D" * int(c[:i].sum()) + "K" + "D" * int(c[i:].sum() - 1) for x, i in costs if x == best]
            if out_audits:
                out[entry, end] = best, min(out_audits)
            continue
        if end >= USER:
            table = tables[end]
            expected = ASSISTANT if entry == USER else USER
            begin = 1 if expected == end else 2  # strings from the expected symbol to the end have lengths of one parity
            options = [(None, 0, table[0, begin::2])]
            if entry == START and end != START:
                first = 1 if end == USER else 2
                options += [(i, int(before[i] + keeping[i]), table[i + 1, first::2]) for i in systems]
            for system, extra, costs in options:
                if not len(costs):
                    continue
                least = int(costs.min()) + extra
                if least < best:
                    best, found = least, []
                if least == best and best < NEVER:
                    found += [(system, r) for r in (begin + 2 * np.flatnonzero(costs + extra == best)).tolist()]
        if best >= NEVER:
            continue
        audits = set()
        for system, r in found:
            if not r:
                audits.add(all_gone[1])
            elif system is None:
                audits.add(trace(tables[end], symbols, faults, copies, end, 0, r))
            else:
                audits.add("D" * int(c[:system].sum()) + "K" + "D" * (copies[system] - 1) + trace(tables[end], symbols, faults, copies, end, system + 1, r))
        out[entry, end] = best, min(audits)
    return out


WHOLE = ((START, START), (START, ASSISTANT))  # from nothing to a whole conversation
ALL = tuple((a, b) for a in range(4) for b in range(4) if b >= a or a == ASSISTANT and b == USER)


def joined(segments: list[dict]) -> dict[tuple[int, int], tuple[int, str]]:
    """Segments one after another: least cost and first audit between any two states, neighbours first."""
    while len(segments) > 1:
        pairs = []
        for one, other in zip(segments[::2], segments[1::2]):
            made: dict = {}
            for (a, b), (cost, audit) in one.items():
                for (c, d), (rest, later) in other.items():
                    if b == c:
                        option = cost + rest, audit + later
                        if (a, d) not in made or option < made[a, d]:
                            made[a, d] = option
            pairs.append(made)
        segments = pairs + segments[len(pairs) * 2:]
    return segments[0]


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of the rows after faults planted by crc32(``conv_id:turn``) % 20; a NULL counts as one space.

    0 drops the row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_id).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"),
                     F.coalesce(F.col(text).cast("string"), blank).alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fault")).where("fault <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _digest(role: Column, text: Column) -> Column:
    """128 bits of role and text."""
    return F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))


def described(rows: DataFrame) -> DataFrame:
    """Turns without texts: equal rows (conversation, turn, role and text) are one with a number of copies.

    ``fault`` is what an alignment needs, ``blank`` and ``seen`` (role and text came earlier) say why.
    """
    clean = F.rtrim("text", F.lit(BLANKS))
    light = rows.select("conv_id", "turn", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), _digest(F.col("role"), F.col("text")).alias("digest"),
                        (clean == "").alias("blank"), (~F.right(clean, F.lit(1)).isin(".", "!", "?")).alias("broken"))
    light = light.groupBy("conv_id", "turn", "digest").agg(F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("broken").alias("broken"),
                                                            F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = light.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    light = join_summary(light, first, ["conv_id", "digest"], "n")
    # rows of one turn and digest are one row here, so a row is not the first of its kind only if its turn is not
    return light.withColumn("seen", ~place.eqNullSafe(F.col("first"))).drop("first")


def in_order(turns: DataFrame) -> DataFrame:
    """The turns sorted over range partitions, with the number of theirs; a table, so the borders stay where they are."""
    place = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("initial"), F.col("digest")]
    return materialize(turns.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("part", F.spark_partition_id()))


def _parts(ordered: DataFrame) -> DataFrame:
    """One row per conversation and range partition: its figures and, per pair of states, cost and audit of its turns there."""
    kind = ordered.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind)] + [T.StructField(n, t) for n, t in FIGURES])
    arrow = pa.schema([(n, to_arrow_type(t)) for n, t in FIGURES])

    def run(batches):
        known: dict = {}  # short conversations repeat one another's faults

        def aligned(rows, pairs):
            key = (tuple(r[0] for r in rows), tuple(r[1] for r in rows), tuple(r[2] for r in rows), pairs)
            if key not in known:
                if len(known) > 50_000 or len(rows) > 24:
                    return align(*(list(x) for x in key[:3]), pairs)
                known[key] = align(*(list(x) for x in key[:3]), pairs)
            return known[key]

        class Open:
            """The conversation at hand: rows of the open segment and what earlier ones gave."""

            def __init__(self, conv, part):
                self.conv, self.part = conv, part
                self.rows, self.parts, self.figures = [], [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                self.low = self.high = None
                self.first = self.last = None

            def add(self, turn, initial, blank, seen, broken, copies):
                figures = self.figures
                fault = FORCED if blank or seen else BROKEN if broken else FREE
                figures["blank"] += copies if blank else 0
                figures["duplicate"] += 0 if blank else copies if seen else copies - 1
                figures["truncated"] += int(fault == BROKEN)
                if self.last is None:
                    self.first = initial
                else:
                    figures["illegal"] += (self.last + initial) not in LEGAL
                figures["illegal"] += (copies - 1) * ((initial + initial) not in LEGAL)
                self.last = initial
                if turn is not None:
                    figures["turns"] += turn != self.high
                    self.low = turn if self.low is None else self.low
                    self.high = turn
                self.rows.append(({"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, 0), fault, copies))
                if len(self.rows) == SEGMENT:
                    self.cut(ALL)

            def cut(self, pairs):
                if self.rows:
                    self.parts.append(aligned(self.rows, pairs))
                    self.rows = []

            def row(self, whole):
                self.cut(WHOLE if whole and not self.parts else ALL)
                found = joined(self.parts)
                f = self.figures
                return (self.conv, self.part, f["blank"], f["duplicate"], f["truncated"], f["illegal"], f["turns"], self.low, self.high, self.first, self.last,
                        [{"entry": a, "end": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in found.items()])

        open_, first_one, made, conv_kind = None, True, [], None

        def batch_of(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_kind)] + [pa.array(c, t.type) for c, t in zip(columns[1:], arrow)], names=["conv_id", *arrow.names])

        for batch in batches:
            conv_kind = batch.schema.field("conv_id").type
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "turn", "initial", "blank", "seen", "broken", "copies", "part")]
            for conv, turn, initial, blank, seen, broken, copies, part in zip(*columns):
                if open_ is None or conv != open_.conv:
                    if open_ is not None:
                        made.append(open_.row(not first_one))  # the first and the last one of a partition may lie in others too
                        first_one = False
                    open_ = Open(conv, part)
                open_.add(turn, initial, blank, seen, broken, copies)
            if len(made) >= 1000:
                yield batch_of(made)
                made = []
        if open_ is not None:
            made.append(open_.row(False))
            yield batch_of(made)

    return ordered.mapInArrow(run, schema)


PAIR = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
FIGURES = [("part", T.IntegerType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()),
           ("turns", T.LongType()), ("low", T.LongType()), ("high", T.LongType()), ("first", T.StringType()), ("last", T.StringType()), ("parts", T.ArrayType(PAIR))]


PIECE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("audit", T.StringType()), T.StructField("state", T.IntegerType()),
                      T.StructField("step", T.LongType())])


def _conversations(parts: DataFrame) -> DataFrame:
    """One row per conversation: figures, cost, audit, and what of the audit each of its partitions has; mostly it lies in one."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([parts.schema["conv_id"]] + [T.StructField(n, T.LongType()) for n in names] +
                          [T.StructField("audit", T.StringType()), T.StructField("pieces", T.ArrayType(PIECE))])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def chosen(segments):
        """The audit of each segment on the cheapest way, the first in ASCII order, from nothing to a whole conversation."""
        best = {START: (0, "", ()), ASSISTANT: (0, "", ())}  # from a state to the end: cost, audit, pieces
        for segment in reversed(segments):
            made: dict = {}
            for (a, b), (cost, audit) in segment.items():
                if b in best:
                    rest = best[b]
                    option = cost + rest[0], audit + rest[1], ((audit, a), *rest[2])
                    if a not in made or option[:2] < made[a][:2]:
                        made[a] = option
            best = made
        return best[START]

    def summed(rows):
        figures = dict.fromkeys(names, 0)
        low = high = last = None
        turns = step = 0
        for r in rows:
            for name in ("blank", "duplicate", "truncated", "illegal"):
                figures[name] += r[name]
            figures["illegal"] += last is not None and (last + r["first"]) not in LEGAL
            last = r["last"]
            if r["low"] is not None:
                turns += r["turns"] - (r["low"] == high)
                low = r["low"] if low is None else low
                high = r["high"]
        figures["gaps"] = 0 if low is None else high - low + 1 - turns
        figures["cost"], audit, found = chosen([{(p["entry"], p["end"]): (p["cost"], p["audit"]) for p in r["parts"]} for r in rows])
        pieces = []
        for r, (own, state) in zip(rows, found):
            pieces.append({"part": r["part"], "audit": own, "state": state, "step": step})
            step += len(own)
        return (rows[0]["conv_id"], *figures.values(), audit, pieces)

    def run(batches):
        held = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    made.append(summed(held))
                    held = []
                held.append(row)
            if made:
                yield batch_of(made)
        if held:
            yield batch_of([summed(held)])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def audits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces) and their turns ``in_order``."""
    ordered = in_order(described(rows))
    return materialize(_conversations(_parts(ordered))), ordered


def edits(conversations: DataFrame, ordered: DataFrame) -> DataFrame:
    """(conv_id, step, edit, turn, digest, role) of what stays or comes in; ``step`` counts a conversation's edits from 0.

    A partition's share of an audit leads the turns it is about, so a long conversation is read in several tasks.
    """
    piece = F.col("piece")
    heads = conversations.select("conv_id", F.explode("pieces").alias("piece")).select(
        "conv_id", piece.part.alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("initial"),
        F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("copies"), piece.audit.alias("audit"), piece.state.alias("state"), piece.step.alias("step"))
    turns = ordered.select("conv_id", "part", F.lit(1).alias("kind"), "turn", "initial", "digest", "copies", F.lit("").alias("audit"), F.lit(0).alias("state"),
                           F.lit(0).cast("long").alias("step"))
    dealt = heads.unionByName(turns).repartition("conv_id", "part")
    dealt = dealt.sortWithinPartitions("conv_id", "part", "kind", F.col("turn").asc_nulls_first(), "initial", "digest")
    schema = T.StructType([ordered.schema["conv_id"], T.StructField("step", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("role", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    names = {USER: "user", ASSISTANT: "assistant"}
    columns = ["conv_id", "kind", "turn", "initial", "digest", "copies", "audit", "state", "step"]

    def run(batches):
        audit, at, state, conv, start = "", 0, START, None, 0

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = ASSISTANT if state == USER else USER
                yield conv, start + at, "I", None, None, names[state]
                at += 1

        for batch in batches:
            made = []
            for conv_id, kind, turn, initial, digest, copies, own, entry, step in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in columns)):
                if kind == 0:
                    audit, at, state, conv, start = own, 0, entry, conv_id, step
                else:
                    edit = audit[at]
                    if edit == "K":
                        state = {s: x for x, s in INITIALS.items()}[initial]
                        made.append((conv, start + at, edit, turn, digest, None))
                    elif edit == "R":
                        state = ASSISTANT if state == USER else USER
                        made.append((conv, start + at, edit, turn, digest, names[state]))
                    at += copies
                made += inserted()
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def repair(rows: DataFrame, conversations: DataFrame, ordered: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, step, edit, turn, role, text) of rows (conv_id, turn, role, text).

    Kept and re-roled turns keep their texts; inserted ones have no turn number and an empty text. Deleted turns are not among them.
    """
    made = edits(conversations, ordered).withColumnsRenamed({"conv_id": "of", "turn": "at", "digest": "what", "role": "new"})
    texts = rows.withColumn("digest", _digest(F.col("role"), F.col("text"))).groupBy("conv_id", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    same = F.col("of").eqNullSafe(F.col("conv_id")) & F.col("at").eqNullSafe(F.col("turn")) & (F.col("what") == F.col("digest"))
    return made.join(texts, same, "left").select(F.col("of").alias("conv_id"), "step", "edit", F.col("at").alias("turn"), F.coalesce("new", "role").alias("role"),
                                                 F.coalesce("text", F.lit("")).alias("text"))


def hashed(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns, ``role:text`` lines in order.

    SHA-256 of a sequence is sequential, so a conversation's texts stream through one task here; nothing of them is held.
    """
    small_batches(repaired.sparkSession)
    kind = repaired.schema["conv_id"].dataType
    ordered = repaired.select("conv_id", "step", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "step")

    def run(batches):
        conv, state, begun = None, None, False
        for batch in batches:
            made = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "role", "text")]
            for conv_id, role, text in zip(*columns):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if begun and conv_id == conv:
                    state.update(b"\n" + line)
                    continue
                if begun:
                    made.append((conv, state.hexdigest()))
                conv, state, begun = conv_id, hashlib.sha256(line), True
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), (batch.schema.field("conv_id").type, pa.string()))],
                                                 names=["conv_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field("conv_id").type), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, T.StructType([T.StructField("conv_id", kind), T.StructField("repaired_sha256", T.StringType())]))


def report(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``df`` after ``damage``: its figures, cost and audit of the repair, and the hash of what comes out.

    A NULL conv_id is a conversation like others; rows without turn come first; rows of one turn are ordered by the role's initial and a hash, so
    equal ones stand together. A conversation that lost all rows has zeros, an empty audit and the hash of nothing, and an empty table gives
    an empty one. A role that is empty fits no place of the grammar. Other columns are not read.
    """
    rows = damage(df, conv_id, turn, role, text)
    found, ordered = audits(rows)
    hashes = hashed(repair(rows, found, ordered))
    every = df.select(F.col(conv_id).alias("conv_id")).distinct()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    mine = found.select(F.col("conv_id").alias("of"), *names, "audit")
    hashes = hashes.select(F.col("conv_id").alias("from"), "repaired_sha256")
    joined_ = every.join(mine, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("from")), "left")
    return joined_.select("conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names], F.coalesce("audit", F.lit("")).alias("audit"),
                          F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
