"""Rate limits over tables: what a limit admits depends on what it admitted before, yet no key is one task.

Rows are sorted over range partitions, so a key that holds a third of them lies in many. Two rules:

``first_hit``: a window opens with its first hit. The next window's first hit is a pure function of this one's, a pointer; the
rows that open windows are an orbit of it. Pointers of all rows of a batch come from one sort, orbits from pointer doubling. For a
partition that holds nothing but one key, a table says for every row that could open its first window which one opens its last;
such tables compose along the key, one look-up a partition.

``trailing``: at most so many pass in any trailing window. The state is the last passed times, too many for a table. A
partition of one key is decided as if nothing came before it, then again with what its predecessor ends with, until no end changes:
two rounds where a lull or a coincidence makes the histories meet, one more for each partition in a row that stays busy and out of step.

Only what crosses a partition's border (a start and a count, or the last times) travels: one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import materialize

State = tuple[int, ...] | None  # first_hit: the open window's start and its hits so far; trailing: the last times that passed


# ---------------------------------------------------------------- one key at a time


def first_hit(times: np.ndarray, limit: int, window_us: int, state: State) -> tuple[np.ndarray, State]:
    """A window opens with its first hit; at most ``limit`` hits pass until one comes a window later.

    ``times`` ascend. Returns who passes, and the state after.
    """
    passes, at = np.zeros(len(times), bool), 0
    while at < len(times):
        start, hits = state if state and times[at] < state[0] + window_us else (int(times[at]), 0)
        end = int(np.searchsorted(times, start + window_us))
        passes[at:min(end, at + max(0, limit - hits))] = True
        state, at = (start, hits + end - at), end
    return passes, state


def trailing(times: np.ndarray, limit: int, window_us: int, state: State) -> tuple[np.ndarray, State]:
    """At most ``limit`` pass in any trailing window; who does not pass does not count.

    ``state`` holds the last ``limit`` times that passed.
    """
    passes, last, at = np.zeros(len(times), bool), list(state or ())[-limit:], 0
    while at < len(times) and limit > 0:
        if len(last) == limit and times[at] < last[0] + window_us:
            at = int(np.searchsorted(times, last[0] + window_us))
            continue
        passes[at] = True
        last = [*last, int(times[at])][-limit:]
        at += 1
    return passes, tuple(last)


# ---------------------------------------------------------------- all keys of a batch at once


def pointers(group: np.ndarray, times: np.ndarray, window_us: int) -> np.ndarray:
    """For each row the first one of its group a window later; ``len(times)`` if there is none. Rows are sorted by group and time."""
    n = len(times)
    order = np.lexsort((np.repeat([0, 1], n), np.concatenate([times + window_us, times]), np.concatenate([group, group])))
    asks = order < n  # a question stands before the rows that it may find
    found = np.empty(n, np.int64)
    found[order[asks]] = np.cumsum(~asks)[asks]
    return np.where((found < n) & (group[np.minimum(found, n - 1)] == group), found, n)


def orbit(jump: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which rows the pointers reach from the roots, by doubling."""
    n = len(jump)
    jump, reached = np.append(jump, n), np.zeros(n + 1, bool)
    reached[roots] = True
    while (jump[:n] < n).any():
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def last_reached(jump: np.ndarray) -> np.ndarray:
    """For each row the last one that its pointers reach, by doubling."""
    n = len(jump)
    own = np.arange(n + 1)
    last = np.where(np.append(jump, n) < n, np.append(jump, n), own)
    while True:
        further = last[last]
        if (further == last).all():
            return last[:n]
        last = further


def batch_first_hit(group: np.ndarray, times: np.ndarray, limit: int, window_us: int, state: State) -> tuple[np.ndarray, State]:
    """Who of several keys passes; ``state`` is the first group's before, the returned one the last group's after."""
    n = len(times)
    roots = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    start, hits = state or (0, 0)
    open_rows = 0  # of the first group, still in the window that was open before
    if state:
        size = int(roots[1]) if len(roots) > 1 else n
        open_rows = int(np.searchsorted(times[:size], start + window_us))
        roots = np.r_[open_rows, roots[1:]] if open_rows < size else roots[1:]
    opens = orbit(pointers(group, times, window_us), roots)
    at = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
    rank = np.arange(n) - at
    rank[:open_rows] = hits + np.arange(open_rows)
    after = (int(times[at[-1]]), n - int(at[-1])) if n > open_rows else (start, hits + n)
    return rank < limit, after


def batch_trailing(group: np.ndarray, times: np.ndarray, limit: int, window_us: int, state: State) -> tuple[np.ndarray, State]:
    n = len(times)
    edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), n]
    # fewer than ``limit`` rows in a row's window, passed or not: it passes, and nobody has to be counted
    passes = np.ones(n, bool) if limit > 0 else np.zeros(n, bool)
    if 0 < limit < n:
        passes[limit:] = (group[limit:] != group[:-limit]) | (times[limit:] - times[:-limit] >= window_us)
    sure = np.logical_and.reduceat(passes, edges[:-1])
    if state:
        sure[0] = False
    for i in np.flatnonzero(~sure).tolist():
        a, b = edges[i], edges[i + 1]
        passes[a:b], _ = trailing(times[a:b], limit, window_us, state if i == 0 else None)
    a = edges[-2]
    before = list(state or ()) if len(edges) == 2 else []
    return passes, tuple([*before, *times[a:][passes[a:]].tolist()][-limit:]) if limit > 0 else ()


RULES = {"first_hit": first_hit, "trailing": trailing}
BATCHES = {"first_hit": batch_first_hit, "trailing": batch_trailing}


def end_table(times: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """For a partition of one key: which row opens its last window, by the row that opens its first one there.

    (last row of a run of first rows, last opening row). A window that is open before the partition ends less than a window after
    its first row, so later rows cannot be the first to open one.
    """
    last = last_reached(pointers(np.zeros(len(times), np.int8), times, window_us))
    most = min(len(times), int(np.searchsorted(times, times[0] + window_us)) + 1)
    ends = np.r_[np.flatnonzero(last[1:most] != last[:most - 1]), most - 1]
    return times[ends], np.stack([times[last[ends]], len(times) - last[ends]], 1)


def table_end(table: tuple[np.ndarray, np.ndarray], rows: int, final: int, window_us: int, state: State) -> State:
    """The state after a partition of one key; ``final`` is its last time."""
    if state and final < state[0] + window_us:
        return state[0], state[1] + rows
    firsts, ends = table
    found = ends[int(np.searchsorted(firsts, state[0] + window_us)) if state else 0]
    return int(found[0]), int(found[1])


# ---------------------------------------------------------------- over a table


def changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; NULL equals NULL."""
    if len(column) < 2:
        return np.zeros(0, bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    gone_a, gone_b = pc.is_null(a), pc.is_null(b)
    return pc.if_else(pc.or_(gone_a, gone_b), pc.xor(gone_a, gone_b), pc.not_equal(a, b)).to_numpy(zero_copy_only=False)


def _borders(ordered: DataFrame, limit: int, window_us: int, rule: str) -> DataFrame:
    """Per partition one row for its first key and, if it has more, one for its last: what goes on behind the partition.

    ``ends``: the state after, of a key that begins here (or, of a partition of one key, as if it did). ``firsts`` and ``lasts``: the table of a partition of one key.
    """
    key_type = ordered.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, first, part, several, key, held, count = None, None, None, False, None, [], 0
        for batch in batches:
            keys, times = batch.column(0), batch.column(1).to_numpy()
            if not len(times):
                continue
            cuts = np.flatnonzero(changes(keys)) + 1
            if kind is None:
                kind, part, key = keys.type, batch.column(2)[0].as_py(), keys[0].as_py()
                first = key
            elif keys[0].as_py() != key:
                several, held, key = True, [], keys[0].as_py()
            if len(cuts):
                several, held, key = True, [], keys[int(cuts[-1])].as_py()
            held.append(times[int(cuts[-1]) if len(cuts) else 0:])
        if kind is None:
            return
        own = np.concatenate(held)
        _, end = RULES[rule](own, limit, window_us, None)
        table = end_table(own, window_us) if rule == "first_hit" and not several else None
        rows = [(first, part, not several, 0 if several else len(own), 0 if several else int(own[-1]), None if several else list(end),
                 None if table is None else table[0].tolist(), None if table is None else table[1].ravel().tolist())]
        if several:
            rows.append((key, part, False, len(own), int(own[-1]), list(end), None, None))
        kinds = [kind, pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "part", "whole", "n", "final", "ends", "firsts", "lasts"])

    shape = f"key {key_type}, part int, whole boolean, n long, final long, ends array<long>, firsts array<long>, lasts array<long>"
    return ordered.select("__key", "__at", "__part").mapInArrow(run, shape)


def _entries(borders: DataFrame, window_us: int) -> DataFrame:
    """(part, state) of partitions whose first key goes on: the last state of the partition before, tables composed along a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["key"] != key:
                    key, state, begun = row["key"], None, True
                elif state is not None:
                    out.append((row["part"], list(state)))
                if row["whole"] and row["firsts"] is not None:
                    table = np.array(row["firsts"]), np.array(row["lasts"]).reshape(-1, 2)
                    state = table_end(table, row["n"], row["final"], window_us, state)
                elif row["ends"] is not None:
                    state = tuple(row["ends"])
                else:  # the key ends in this partition
                    state = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([s for _, s in out], pa.list_(pa.int64()))], names=["part", "state"])

    return borders.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "part int, state array<long>")


def _settled(ordered: DataFrame, borders: DataFrame, limit: int, window_us: int) -> DataFrame:
    """``_entries`` of the trailing rule: partitions of one key are decided again until what they end with does not change."""
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, ()
        for batch in batches:
            if batch.num_rows:
                if part is None:
                    part, state = batch.column(1)[0].as_py(), tuple(batch.column(2)[0].as_py())
                _, state = batch_trailing(np.zeros(batch.num_rows, np.int8), batch.column(0).to_numpy(), limit, window_us, state)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(state)], pa.list_(pa.int64()))], names=["part", "now"])

    entries = _entries(borders, window_us)
    if borders.where("whole").isEmpty():
        return entries
    known = None
    while True:
        entries = materialize(entries)
        if known is not None and entries.exceptAll(known).isEmpty():
            return entries
        # a partition of one key is a partition of the sorted table, so its rows are read where they lie
        asked = borders.where("whole").join(entries, "part").select("part", "state")
        ends = ordered.select("__at", F.col("__part").alias("part")).join(F.broadcast(asked), "part").select("__at", "part", "state").mapInArrow(again, "part int, now array<long>")
        borders = materialize(borders.join(ends, "part", "left").withColumn("ends", F.when(F.col("whole"), F.coalesce("now", "ends")).otherwise(F.col("ends"))).drop("now"))
        known, entries = entries, _entries(borders, window_us)


def rate_limit(rows: DataFrame, key: str, limit: int, window_seconds: int, rule: str) -> DataFrame:
    """Rows (id, key, ts) with ``admitted``, judged in order of (ts, id) per key; a NULL key is a key."""
    window_us = window_seconds * 1_000_000
    named = rows.withColumns({"__key": F.col(key), "__at": F.unix_micros("ts")})
    place = [F.col("__key"), F.col("__at"), F.col("id")]
    ordered = materialize(named.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("__part", F.spark_partition_id()))
    borders = materialize(_borders(ordered, limit, window_us, rule))
    entries = _settled(ordered, borders, limit, window_us) if rule == "trailing" else _entries(borders, window_us)
    entries = entries.select(F.col("part").alias("__of"), F.col("state").alias("__state"))
    shape = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    columns = rows.columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key_before, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keys, times = at["__key"], at["__at"].to_numpy()
            if not begun:
                held = at["__state"][0].as_py()
                state, begun = tuple(held) if held is not None else None, True
            elif keys[0].as_py() != key_before:
                state = None
            key_before = keys[-1].as_py()
            group = np.concatenate([[0], np.cumsum(changes(keys))])
            passes, state = BATCHES[rule](group, times, limit, window_us, state)
            yield pa.RecordBatch.from_arrays([*(at[c] for c in columns), pa.array(passes)], names=[*columns, "admitted"])

    # one row a partition at most is broadcast
    return ordered.join(F.broadcast(entries), F.col("__part") == F.col("__of"), "left").mapInArrow(decide, f"{shape}, admitted boolean")
