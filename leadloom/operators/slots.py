"""The slot of every request: mailboxes hand out send times in arrival order, yet no mailbox is one task.

With at most ``cap`` slots a local day, slot n of a mailbox is the first moment in its request's window that is no earlier than the request's
earliest time, than slot n-1 plus the gap, and than the day after slot n-cap. All three rise with what they depend on and enter
by a maximum, so a stretch of requests turns the last ``cap`` slots before it into the greater, place by place, of two things: what it would end with if nothing came before, and what
the slots before it lead to when no request asks for a later time. The second repeats from day to day: it is known from where the
stretch's first new day begins, and days that begin at one request go on alike, whatever their date.

So requests are sorted over range partitions. A partition that holds nothing but one pool tells what it ends with alone, its first
requests, and for each of them where a day that begins there leads; that is a few rows of ``cap`` numbers, whatever it holds. Along a pool these foretell what every partition
begins with, and all partitions hand out their slots at once. What they end with is then held against what was foretold (a change of
clocks, several zones or several mailboxes in a pool may prove it wrong); a partition that began wrongly is run again, so the result never rests on the forecast.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.scale import top_k
from leadloom.session import materialize

MAX_DAYS_TRIED = 366
ALWAYS = -(1 << 62)  # an earliest time that asks for nothing
DAY = 86_400_000_000


class Days:
    """Local days in UTC microseconds, per zone and window; looked up once per day."""

    def __init__(self):
        self._zones, self._bounds, self._recent = {}, {}, {}

    def _micros(self, day: dt.date, seconds: int, zone: str) -> int:
        tz = self._zones.setdefault(zone, ZoneInfo(zone))
        wall = dt.datetime.combine(day, dt.time(seconds // 3600, seconds // 60 % 60, seconds % 60), tzinfo=tz)
        return int(wall.timestamp()) * 1_000_000

    def date(self, micros: int, zone: str) -> dt.date:
        start, end, day = self._recent.get(zone, (0, 0, None))
        if not start <= micros < end:  # the last day asked for is usually the one asked for again
            tz = self._zones.setdefault(zone, ZoneInfo(zone))
            day = dt.datetime.fromtimestamp(micros // 1_000_000, tz).date()
            self._recent[zone] = (*self.bounds(day, zone, None), day)
        return day

    def bounds(self, day: dt.date, zone: str, window: tuple[int, int] | None) -> tuple[int, int]:
        key = (day, zone, window)
        if key not in self._bounds:
            if len(self._bounds) > 100_000:
                self._bounds.clear()
            following = day + dt.timedelta(days=1)
            self._bounds[key] = ((self._micros(day, window[0], zone), self._micros(day, window[1], zone)) if window
                                 else (self._micros(day, 0, zone), self._micros(following, 0, zone)))
        return self._bounds[key]


def next_slot(days: Days, recent: list[int], cap: int, earliest: int, gap: int, zone: str, window) -> tuple[int, dt.date] | None:
    """A mailbox's next slot and its local day; ``recent`` holds its last ``cap`` slots, ascending."""
    at = max(earliest, recent[-1] + gap) if recent else earliest
    full_day = None
    if len(recent) >= cap:
        last = days.date(recent[-1], zone)
        full_day = last if days.date(recent[-cap], zone) == last else None
    for _ in range(MAX_DAYS_TRIED):
        day = days.date(at, zone)
        begin, finish = days.bounds(day, zone, window)
        at = max(at, begin)
        if at < finish and day != full_day:
            return at, day
        at = days.bounds(day + dt.timedelta(days=1), zone, window)[0]
    return None


Boxes = dict[int, list[int]]  # a pool's mailboxes in order of priority, with their last slots


def place(days: Days, boxes: Boxes, cap: int, request: tuple) -> tuple[int | None, int | None]:
    """The mailbox and slot of a request (earliest, gap, zone, window, previous mailbox); the mailbox remembers it."""
    earliest, gap, zone, window, first = request
    best = None
    # in mailbox order, the previous mailbox first; the earliest local day wins, the first box on ties
    for box in sorted(boxes, key=lambda b: b != first) if first in boxes else boxes:
        found = next_slot(days, boxes[box], cap, earliest, gap, zone, window)
        if found and (best is None or found[1] < best[2]):
            best = (box, *found)
    if not best:
        return None, None
    boxes[best[0]] = [*boxes[best[0]], best[1]][-cap:]
    return best[0] or None, best[1]


# ---------------------------------------------------------------- forecasts


def outlook(days: Days, requests: list[tuple], cap: int) -> dict | None:
    """What a stretch of requests to one mailbox does to the slots before it; None if it is too short to tell."""
    if len(requests) < 3 * cap + 2:
        return None
    alone: Boxes = {1: []}
    for r in requests:
        place(days, alone, cap, (*r[:4], None))
    if len(alone[1]) < cap:
        return None
    reference = days.date(alone[1][0], requests[0][2])
    known: dict[int, tuple[int, int] | None] = {}

    def begin(i: int) -> int:
        return days.bounds(reference, requests[i][2], requests[i][3])[0]

    def follow(i: int):
        """From a day that begins at request i: (the request at which the next one begins, days later), or None at the end."""
        if i not in known:
            recent, known[i] = [begin(i)], None
            for k in range(i + 1, len(requests)):
                _, gap, zone, window, _ = requests[k]
                found = next_slot(days, recent, cap, ALWAYS, gap, zone, window)
                if found is None:
                    break
                if found[0] == days.bounds(found[1], zone, window)[0] and found[1] != days.date(recent[-1], zone):
                    known[i] = k, (found[1] - reference).days
                    break
                recent = [*recent, found[0]][-cap:]
        return known[i]

    table = []
    for i in range(cap + 2):
        path, at, later = [(i, 0)], i, 0
        while (step := follow(at)) is not None:
            at, later = step[0], later + step[1]
            path.append((at, later))
        start, later = next((p for p in reversed(path) if p[0] <= len(requests) - cap), path[0])
        recent = [begin(start)]
        for _, gap, zone, window, _ in requests[start + 1:]:
            found = next_slot(days, recent, cap, ALWAYS, gap, zone, window)
            if found is None:
                return None
            recent = [*recent, found[0]][-cap:]
        table.append([x + later * DAY for x in recent])
    head = [[gap, zone, list(window) if window else None] for _, gap, zone, window, _ in requests[:cap + 2]]
    return {"alone": alone[1], "head": head, "table": table, "reference": reference.isoformat()}


def foretold(days: Days, view: dict, recent: list[int], cap: int) -> list[int] | None:
    """The last slots after a stretch, from those before it."""
    if not recent:
        return view["alone"]
    reference, after = dt.date.fromisoformat(view["reference"]), list(recent)
    for i, (gap, zone, window) in enumerate(view["head"]):
        window = tuple(window) if window else None
        found = next_slot(days, after, cap, ALWAYS, gap, zone, window)
        if found is None:
            return None
        if found[0] == days.bounds(found[1], zone, window)[0] and found[1] != days.date(after[-1], zone):
            moved = [x + (found[1] - reference).days * DAY for x in view["table"][i]]
            return [max(a, b) for a, b in zip(view["alone"], moved)] if len(moved) == len(view["alone"]) else None
        after = [*after, found[0]][-cap:]
    return None


# ---------------------------------------------------------------- partitions


ROW = ["pool", "position", "email_id", "earliest_us", "gap_us", "zone", "window_start", "window_end", "previous_mailbox_id", "state", "part"]


def _requests(batches: Iterator[pa.RecordBatch]):
    """Rows of a partition: (pool, part, position, email, state or None, request)."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ROW]
        for pool, position, email, earliest, gap, zone, start, end, previous, state, part in zip(*columns):
            window = None if start is None or end is None else (start, end)
            yield pool, part, position, email, state, (earliest, gap, zone, window, previous)


def _loaded(state: str) -> Boxes:
    return {int(box): recent for box, recent in json.loads(state)}


def _saved(boxes: Boxes) -> str:
    return json.dumps(list(boxes.items()))


def _ends(cap: int):
    """Per partition its first pool and, if it has more, its last: whether it begins here, what it ends with if so, or the outlook of a partition of one pool.

    Only the last pool's requests are gone through; those of pools that end here lead nowhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, several, of_last, boxes = Days(), False, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            pools = batch.column(batch.schema.get_field_index("pool")).to_pylist()
            start = pools.index(pools[-1])
            if not of_last:
                first, first_state, at = (batch.column(batch.schema.get_field_index(n))[0].as_py() for n in ("pool", "state", "part"))
            elif pools[0] != pool:
                several, of_last = True, []
            if start:
                several, of_last = True, []
            pool = pools[-1]
            of_last.append(batch.slice(start))
        if not of_last:
            return
        begins, first_begins, whole = of_last[0].column(of_last[0].schema.get_field_index("state"))[0].is_valid, first_state is not None, not several
        requests = _requests(of_last.pop(0) for _ in range(len(of_last)))  # a batch goes once its rows are read
        if begins:
            for _, _, _, _, state, request in requests:
                if state is not None:
                    boxes = _loaded(state)
                else:
                    place(days, boxes, cap, request)
        rows = [(first, at, first_begins, whole, _saved(boxes) if whole and begins else None,
                 json.dumps(outlook(days, [r[5] for r in requests], cap)) if whole and not begins else None)]
        if several:
            rows.append((pool, at, begins, False, _saved(boxes) if begins else None, None))
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pool", "part", "begins", "whole", "ends", "view"])

    return run


def _forecast(cap: int):
    """Along every pool, what each of its partitions begins with, as far as it can be foretold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, pool, state, begun = Days(), None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["pool"] != pool:
                    pool, state, begun = row["pool"], None, True
                if not row["begins"]:
                    out.append((row["part"], state))
                if row["ends"] is not None:
                    state = row["ends"]
                elif row["whole"] and state is not None and row["view"] not in (None, "null") and len(boxes := _loaded(state)) == 1:
                    (box, recent), = boxes.items()
                    after = foretold(days, json.loads(row["view"]), recent, cap)
                    state = None if after is None else _saved({box: after})
                else:
                    state = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([s for _, s in out], pa.string())], names=["part", "entry"])

    return run


OUT = "pool long, position long, email_id long, mailbox_id long, slot_us long, part int, ends string"


def _handed_out(cap: int):
    """The slots of a partition's requests, and in a last row what its last pool ends with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, pool, boxes, part, out = Days(), None, {}, None, []

        def batch_of(rows):
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pool", "position", "email_id", "mailbox_id", "slot_us", "part", "ends"])

        for batch in batches:
            if batch.num_rows and part is None:
                entry = batch.column(batch.schema.get_field_index("entry"))[0].as_py()
                boxes = _loaded(entry) if entry is not None else {}
            for pool, part, position, email, state, request in _requests([batch]):
                if state is not None:  # a pool begins
                    boxes = _loaded(state)
                    continue
                out.append((pool, position, email, *place(days, boxes, cap, request), part, None))
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if part is not None:
            yield batch_of([*out, (pool, None, None, None, None, part, _saved(boxes))])

    return run


def hand_out(rows: DataFrame, cap: int) -> DataFrame:
    """(pool, position, email_id, mailbox_id, slot_us) of the requests; ``rows`` holds them and one row per pool with its state, before them."""
    order = [F.col("pool"), F.col("state").isNull(), F.col("position")]
    ordered = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    ends = materialize(ordered.select(*ROW).mapInArrow(_ends(cap), "pool long, part int, begins boolean, whole boolean, ends string, view string"))
    entries = ends.repartition("pool").sortWithinPartitions("pool", "part").mapInArrow(_forecast(cap), "part int, entry string")
    # from here on one row a partition is in hand, on the driver and in broadcasts
    goes_on = {r.part: r.entry for r in entries.collect()}
    parts = sorted({r.part for r in ends.select("part").collect()})
    before = dict(zip(parts[1:], parts[:-1]))
    session, todo, actual, rounds = rows.sparkSession, [p for p in parts if p not in goes_on or goes_on[p] is not None], {}, []
    last: dict[int, int] = {}
    while todo:
        asked = session.createDataFrame([(p, goes_on.get(p)) for p in todo], "of int, entry string")
        made = ordered.join(F.broadcast(asked), F.col("part") == F.col("of")).select(*ROW, "entry").mapInArrow(_handed_out(cap), OUT)
        made = materialize(made)
        actual |= {r.part: r.ends for r in made.where("ends IS NOT NULL").select("part", "ends").collect()}
        last |= {p: len(rounds) for p in todo}
        rounds.append(made)
        todo = [p for p in goes_on if before[p] in actual and actual[before[p]] != goes_on[p]]
        goes_on |= {p: actual[before[p]] for p in todo}
    kept = session.createDataFrame(list(last.items()), "of int, turn int") if last else None
    result = None
    for turn, made in enumerate(rounds):
        own = made.join(F.broadcast(kept.where(F.col("turn") == turn)), F.col("part") == F.col("of"), "left_semi").where("ends IS NULL")
        result = own if result is None else result.unionByName(own)
    if result is None:
        result = session.createDataFrame([], OUT)
    return result.drop("part", "ends")


def opening(requests: DataFrame, mailboxes: DataFrame, holders: DataFrame, cap: int) -> DataFrame:
    """One row (pool, state) per pool: its mailboxes in order of priority with the last ``cap`` slots that are held.

    A pool without mailboxes gets a stand-in (id 0) that every holder counts against. A pool's mailboxes are a handful.
    """
    pools = requests.select("pool").distinct()
    boxes = pools.join(mailboxes, "pool", "left").withColumn("mailbox_id", F.coalesce("mailbox_id", F.lit(0).cast("long")))
    held = holders.where(F.col("scheduled_at").isNotNull()).select(F.col("mailbox_id").alias("box"), F.unix_micros("scheduled_at").alias("slot"))
    # the last slots of all are among the last of each
    last = materialize(top_k(held, ["box"], [F.desc("slot")], cap).drop("rank"))
    every = top_k(last.withColumn("box", F.lit(0).cast("long")), ["box"], [F.desc("slot")], cap).drop("rank")
    recent = last.where(F.col("box").isNotNull() & (F.col("box") != 0)).unionByName(every).groupBy("box").agg(F.array_sort(F.collect_list("slot")).alias("recent"))
    found = boxes.join(recent, F.col("mailbox_id") == F.col("box"), "left").select(
        "pool", F.struct(F.coalesce("priority", F.lit(0)).alias("priority"), "mailbox_id", F.coalesce("recent", F.array().cast("array<bigint>")).alias("recent")).alias("b"))
    listed = F.array_sort(F.collect_list("b"))
    text = F.transform(listed, lambda b: F.concat(F.lit("["), b["mailbox_id"].cast("string"), F.lit(",["), F.array_join(F.transform(b["recent"], lambda x: x.cast("string")), ","), F.lit("]]")))
    return found.groupBy("pool").agg(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("state"))
