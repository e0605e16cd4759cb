"""Set-wise operators against the sequential rules they replace, on small random tables."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from leadloom.operators import lifecycle, listings, outreach, people, schedule, slots, tables, verify
from leadloom.schemas import Settings
from leadloom.sources.people import load_roles

UTC = dt.timezone.utc


@pytest.mark.parametrize("seed", range(6))
def test_balanced_assignment(spark, seed):
    rng = random.Random(seed)
    sequences = [(c, s) for c in range(8) for s in range(1, rng.randint(2, 6))]
    old = [(c, rng.choice([s for k, s in sequences if k == c])) for c in range(8) for _ in range(rng.randint(0, 12))]
    new = [(i, rng.choice(range(8)) if rng.random() > 0.4 else 3, rng.choice([None, 10, 50, 90])) for i in range(300)]
    size = {}
    for c, s in old:
        size[c, s] = size.get((c, s), 0) + 1
    expected = {}
    for i, c, _ in sorted(new, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        best = min((s for k, s in sequences if k == c), key=lambda s: (size.get((c, s), 0), s))
        size[c, best] = size.get((c, best), 0) + 1
        expected[i] = best
    got = outreach.balanced_assignment(spark.createDataFrame(old, "campaign_id long, email_sequence_id long"),
                                       spark.createDataFrame(new, "id long, campaign_id long, qualification_score int"),
                                       spark.createDataFrame(sequences, "campaign_id long, sequence_id long"))
    assert {r.id: r.sequence_id for r in got.collect()} == expected


def test_balance_example(spark):
    two = spark.createDataFrame([(1, 1), (1, 2)], "campaign_id long, sequence_id long")
    new = spark.createDataFrame([(i, 1, None) for i in range(4)], "id long, campaign_id long, qualification_score int")
    nobody = spark.createDataFrame([], "campaign_id long, email_sequence_id long")
    assert sorted(r.sequence_id for r in outreach.balanced_assignment(nobody, new, two).collect()) == [1, 1, 2, 2]
    history = spark.createDataFrame([(1, 1), (1, 1)], "campaign_id long, email_sequence_id long")
    assert [r.sequence_id for r in outreach.balanced_assignment(history, new.where("id = 0"), two).collect()] == [2]


# ---------------------------------------------------------------- listings


def same(a, b):
    if a["place_id"] and b["place_id"]:
        return a["place_id"] == b["place_id"]
    if a["maps_url"] and a["maps_url"] == b["maps_url"]:
        return True
    if not a["name"] or a["name"] != b["name"]:
        return False
    if a["address"] and b["address"]:
        return a["address"] == b["address"]
    return bool(a["domain"] and a["domain"] == b["domain"])


def random_listings(rng, n, start=0):
    pick = lambda values: rng.choice([None, *values])
    return [{"arrival": start + i, "campaign_id": rng.randrange(3), "place_id": pick(["p1", "p2", "p3", "p4"]), "maps_url": pick([f"https://m/{j}" for j in range(6)]),
             "name": pick(["a", "b", "c"]), "address": pick(["x", "y"]), "domain": pick(["d.org", "e.org"])} for i in range(n)]


LISTING = "arrival long, campaign_id long, place_id string, maps_url string, name string, address string, domain string"


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedupe(spark, seed):
    rng = random.Random(seed)
    saved, found = random_listings(rng, 5), random_listings(rng, 80, 100)
    seen, expected = list(saved), {}
    for row in found:
        expected[row["arrival"]] = not any(same(row, other) for other in seen)
        if expected[row["arrival"]]:
            seen.append(row)
    got = listings.greedy_dedupe(spark.createDataFrame(found, LISTING), spark.createDataFrame(saved, LISTING))
    assert {r.arrival: r.accepted for r in got.collect()} == expected


def test_first_match(spark):
    rng = random.Random(9)
    saved, found = random_listings(rng, 60), random_listings(rng, 150, 100)
    expected = {}
    for row in found:
        order = sorted(saved, key=lambda s: (s["campaign_id"] != row["campaign_id"], s["arrival"]))
        expected[row["arrival"]] = next((s["arrival"] for s in order if same(row, s)), None)
    stored = listings.identify(spark.createDataFrame(saved, LISTING)).withColumnRenamed("arrival", "id")
    got = listings.first_match(listings.identify(spark.createDataFrame(found, LISTING)), stored)
    assert {r.arrival: r.match and r.match.id for r in got.collect()} == expected


# ---------------------------------------------------------------- send times


def sequential_slots(requests, boxes, held, settings):
    holders = {b: [t for m, t in held if m == b] for b, _ in boxes}
    result = {}
    for r in requests:
        zone = ZoneInfo(r["zone"])
        day_of = lambda t: t.astimezone(zone).date()  # noqa: B023, E731

        def bounds(day):
            at = lambda d, s: dt.datetime.combine(d, dt.time(s // 3600, s // 60 % 60), tzinfo=zone)  # noqa: B023, E731
            if r["window_start"] is None:  # noqa: B023
                return at(day, 0), at(day + dt.timedelta(days=1), 0)
            return at(day, r["window_start"]), at(day, r["window_end"])  # noqa: B023

        options = []
        for box, _ in sorted(boxes, key=lambda b: (b[0] != r["previous_mailbox_id"], b[1], b[0])):
            times = holders[box]
            at = r["earliest"] if not times else max(r["earliest"], max(times) + dt.timedelta(microseconds=r["gap_us"]))
            while True:
                day = day_of(at)
                begin, finish = bounds(day)
                at = max(at, begin)
                if at < finish and sum(day_of(t) == day for t in times) < settings.daily_cap:
                    break
                at = bounds(day + dt.timedelta(days=1))[0]
            options.append((box, at))
        first = min(day_of(at) for _, at in options)
        box, at = next(o for o in options if day_of(o[1]) == first)
        holders[box].append(at)
        result[r["email_id"]] = (box, at.astimezone(UTC).replace(tzinfo=None))
    return result


REQUEST = "pool long, arrival long, email_id long, earliest timestamp, zone string, window_start int, window_end int, previous_mailbox_id long, gap_us long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_schedule(spark, seed):
    rng = random.Random(seed)
    settings = Settings(daily_cap=rng.choice([2, 3, 5]))
    boxes = [(1, 2), (2, 1), (3, 2)]
    start = dt.datetime(2024, 3, 29, 12, tzinfo=UTC)  # across a clock change
    held = [(rng.choice([1, 2]), start + dt.timedelta(hours=rng.randrange(-30, 30))) for _ in range(12)]
    requests = []
    for i in range(60):
        window = rng.choice([(None, None), (9 * 3600, 18 * 3600), (0, 3 * 3600)])
        requests.append({"pool": 1, "arrival": i, "email_id": 1000 + i, "earliest": start + dt.timedelta(minutes=rng.randrange(0, 4000)),
                         "zone": rng.choice(["Asia/Karachi", "Europe/Berlin", "America/New_York"]), "window_start": window[0], "window_end": window[1],
                         "previous_mailbox_id": rng.choice([None, 1, 3, 9]), "gap_us": rng.randrange(60, 900) * 1_000_000})
    expected = sequential_slots(requests, boxes, held, settings)
    got = schedule.schedule(spark.createDataFrame(requests, REQUEST), spark.createDataFrame([(1, b, p) for b, p in boxes], "pool long, mailbox_id long, priority int"),
                            spark.createDataFrame(held, "mailbox_id long, scheduled_at timestamp"), settings)
    text = F.date_format("slot", "yyyy-MM-dd HH:mm:ss")
    assert {r.email_id: (r.mailbox_id, r.s) for r in got.withColumn("s", text).collect()} == {
        k: (b, t.strftime("%Y-%m-%d %H:%M:%S")) for k, (b, t) in expected.items()}


@pytest.mark.parametrize("seed,boxes,zones,busy", [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 2, 2, True), (5, 1, 1, True)])
def test_a_pool_over_many_partitions(spark, monkeypatch, seed, boxes, zones, busy):
    """One pool fills a dozen partitions, small pools stand around it: as one request after the other. Where one mailbox works in one zone, the forecast is right
    however far it is behind; several mailboxes take one more round a partition."""
    rng = random.Random(seed)
    settings = Settings(daily_cap=rng.choice([4, 7]))
    start = dt.datetime(2024, 2, 1 if seed < 5 else 27, 12, tzinfo=UTC)  # the last one runs across a change of clocks
    names = ["Europe/Berlin", "Asia/Karachi", "America/New_York"][:zones]
    requests = []
    for pool in (1, 2, 3, 4):
        for i in range(1500 if pool == 2 else 40):
            late = rng.random() < (0.02 if busy else 0.5)
            earliest = start + dt.timedelta(minutes=rng.randrange(0, 60) + (rng.randrange(0, 200_000) if late else 0) + (0 if busy else 400 * i))
            requests.append({"pool": pool, "arrival": i, "email_id": 10_000 * pool + i, "earliest": earliest, "zone": rng.choice(names), "window_start": 9 * 3600, "window_end": 12 * 3600,
                             "previous_mailbox_id": None, "gap_us": rng.randrange(300, 3000) * 1_000_000})
    held = [(1 + rng.randrange(8), start + dt.timedelta(hours=rng.randrange(-40, 10))) for _ in range(30)]
    known = [(pool, 2 * pool + b - 1, b) for pool in (1, 2, 3, 4) for b in range(boxes)]
    expected = {}
    for pool in (1, 2, 3, 4):
        expected |= sequential_slots([r for r in requests if r["pool"] == pool], [(b, p) for q, b, p in known if q == pool], held, settings)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns, whole = [], slots._handed_out
    monkeypatch.setattr(slots, "_handed_out", lambda cap: turns.append(1) or whole(cap))
    try:
        got = schedule.schedule(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(known, "pool long, mailbox_id long, priority int"),
                                spark.createDataFrame(held, "mailbox_id long, scheduled_at timestamp"), settings)
        text = F.date_format("slot", "yyyy-MM-dd HH:mm:ss")
        assert {r.email_id: (r.mailbox_id, r.s) for r in got.withColumn("s", text).collect()} == {k: (b, t.strftime("%Y-%m-%d %H:%M:%S")) for k, (b, t) in expected.items()}
        if boxes == zones == 1:
            assert len(turns) <= 3  # a change of clocks within the time that they are behind costs another one
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("begins", [True, False])
def test_only_the_last_pool_of_a_partition_is_gone_through(monkeypatch, begins):
    """What other pools end with leads nowhere; all of them were handed out twice."""
    import pyarrow as pa
    at = 1_704_103_200_000_000
    row = lambda pool, i: (pool, i, 10 * pool + i, at, 60_000_000, "UTC", None, None, None, None, 3)
    opened = lambda pool: (pool, *[None] * 8, "[[7,[]]]", 3)
    rows = [row(1, 8), row(1, 9), opened(2), *[row(2, i) for i in range(30)], opened(3), row(3, 0), row(3, 1)] if begins else [row(1, i) for i in range(4)]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=slots.ROW)
    placed, whole = [], slots.place
    monkeypatch.setattr(slots, "place", lambda days, boxes, cap, request: placed.append(request) or whole(days, boxes, cap, request))
    for size in (1, 2, 7, 100):
        placed.clear()
        found = [r for batch in slots._ends(2)(iter(table.to_batches(size))) for r in batch.to_pylist()]
        if begins:
            assert [(r["pool"], r["part"], r["begins"], r["whole"], r["ends"], r["view"]) for r in found] == [
                (1, 3, False, False, None, None), (3, 3, True, False, f"[[7, [{at}, {at + 60_000_000}]]]", None)]
            assert len(placed) == 2
        else:
            assert [(r["pool"], r["begins"], r["whole"], r["ends"], r["view"]) for r in found] == [(1, False, True, None, "null")]


def test_mailboxes_fill_up_in_order(spark):
    settings = Settings(daily_cap=2, gap_fixed_seconds=60, gap_random_min_seconds=0, gap_random_max_seconds=0)
    now = dt.datetime(2024, 1, 2, 10, tzinfo=UTC)
    rows = [(1, i, i, now, "UTC", None, None, None, 60_000_000) for i in range(5)]
    nobody = spark.createDataFrame([], "mailbox_id long, scheduled_at timestamp")
    got = schedule.schedule(spark.createDataFrame(rows, REQUEST), spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "pool long, mailbox_id long, priority int"), nobody, settings)
    days = [(r.mailbox_id, r.d) for r in got.withColumn("d", F.date_format("slot", "dd")).orderBy("position").collect()]
    assert days == [(7, "02"), (7, "02"), (8, "02"), (8, "02"), (7, "03")]
    none = schedule.schedule(spark.createDataFrame(rows, REQUEST), spark.createDataFrame([], "pool long, mailbox_id long, priority int"), nobody, settings)
    assert [(r.mailbox_id, r.d) for r in none.withColumn("d", F.date_format("slot", "dd")).orderBy("position").collect()] == [
        (None, "02"), (None, "02"), (None, "03"), (None, "03"), (None, "04")]


# ---------------------------------------------------------------- the rest


def test_failure_streak(spark):
    rng = random.Random(3)
    rows = [(run, i, rng.choice([True, False, False, None])) for run in range(30) for i in range(25)]
    expected = {}
    for run in range(30):
        streak = 0
        for _, i, ok in (r for r in rows if r[0] == run):
            streak = streak + 1 if ok is False else 0 if ok else streak
            if ok is False and streak == 3:
                expected[run] = i
                break
    got = verify.failure_streak(spark.createDataFrame(rows, "run_id int, position long, can_connect_smtp boolean"))
    assert {r.run_id: r.stops_at for r in got.collect()} == expected


def test_due_follow_ups(spark):
    prospects = spark.createDataFrame([(1, 1, False, None), (2, 1, False, None), (3, 1, True, None), (4, 1, False, dt.datetime(2024, 1, 1)), (5, 1, False, None), (6, None, False, None)],
                                      "id long, email_sequence_id long, do_not_contact boolean, sequence_stopped_at timestamp")
    sent = dt.datetime(2024, 1, 1)
    emails = spark.createDataFrame([(10 * p + s, p, s, status, sent if status in ("sent", "replied") else None) for p, s, status in (
        (1, 1, "sent"), (2, 1, "replied"), (3, 1, "sent"), (4, 1, "sent"), (5, 1, "sent"), (5, 2, "in_review"), (6, 1, "sent"))],
        "id long, prospect_id long, sequence_step int, status string, sent_at timestamp")
    steps = spark.createDataFrame([(1, 1, 3, 100)], "sequence_id long, sequence int, days_after_previous int, template_id long")
    assert [tuple(r) for r in lifecycle.follow_ups_due(prospects, emails, steps).collect()] == [(1, 2, 1, 11, 100)]


def test_merge_people_joins_variants(spark):
    base = {"business_id": 1, "url": "u", "source": "website", "first_name": "x", "last_name": "y", "job_title": "Dentist", "kind": "fallback", "rank": 50, "role_name": "Dentist",
            "role_type": "dentist", "weak": False, "evidence": "e"}
    said = [("Muhammad Shoaib", "shoaib|shoaib", "Dentist", "fallback", 50), ("Muhammad Shoaib Ahmed", "shoaib|ahmed", "Owner", "target", 0), ("Jane Doe", "jane|doe", "Dentist", "fallback", 50),
            ("Jane R Doe", "jane|rdoe", "Dentist", "fallback", 50)]
    rows = [{**base, "pos": i, "name": n, "person_key": k, "job_title": t, "kind": kind, "rank": rank, "url": f"u{i}"} for i, (n, k, t, kind, rank) in enumerate(said)]
    shape = ("business_id long, pos long, url string, source string, name string, first_name string, last_name string, person_key string, job_title string, kind string, rank int, "
             "role_name string, role_type string, weak boolean, evidence string")
    got = people.merge_people(spark.createDataFrame(rows, shape)).orderBy("arrival").collect()
    assert [(r.person_key, r.name, r.job_title, r.n_sources) for r in got] == [
        ("shoaib|shoaib", "Muhammad Shoaib Ahmed", "Owner", 2), ("jane|doe", "Jane R Doe", "Dentist", 2)]


def test_names_folded_by_parts_are_the_same(spark, monkeypatch):
    """A business of many names, folded whole and by components of names that share a mark."""
    rng = random.Random(4)
    given, family = ["Ann", "Omar", "Lena", "Noor", "Tom", "Sara", "Muhammad"], [f"Fam{i}" for i in range(40)]
    rows = []
    for i in range(900):
        words = rng.sample(given, rng.choice([1, 1, 2])) + [rng.choice(family)] + ([rng.choice(family)] if rng.random() < 0.2 else [])
        rows.append((1 if i % 3 else rng.randrange(2, 9), i, f"u{i % 7}", "website", " ".join(words), words[0], words[-1], f"{words[0]}|{words[-1]}".lower(), "Dentist", "fallback", 50,
                     "Dentist", "dentist", False, f"e{i}"))
    shape = ("business_id long, pos long, url string, source string, name string, first_name string, last_name string, person_key string, job_title string, kind string, rank int, "
             "role_name string, role_type string, weak boolean, evidence string")
    df = spark.createDataFrame(rows, shape)
    whole = people.merge_people(df).collect()
    monkeypatch.setattr(people, "MANY_FORMS", 20)
    assert sorted(whole) == sorted(people.merge_people(df).collect()) and len(whole) > 100


def test_matches_of_a_long_text(spark):
    """20,000 people in one text: work in proportion to it, each in its own line."""
    import time
    line = lambda i: f"Sara Noor{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}, Office Manager number {i}"
    took = []
    for n in (2500, 20_000):
        rows = spark.createDataFrame([(1, "\n".join(line(i) for i in range(n)), "Smile Dental")], "business_id int, text string, business_name string")
        start = time.monotonic()
        got = people.extract_people(rows, ["business_id"]).where("shape = 0").select("at", "evidence").collect()
        took.append(time.monotonic() - start)
        assert len(got) == n and {r.evidence for r in got} == {line(i) for i in range(n)}
        assert max(r["at"] for r in got) == len("\n".join(line(i) for i in range(n - 1))) + 1
    assert took[1] < 40 * max(took[0], 0.5)


def test_a_long_chain_settles(spark, monkeypatch):
    """10,000 listings, each a match of the one before it only: decided by components, not one a round."""
    from leadloom import graphs
    rounds, steps = [], []
    one, whole = listings._round, graphs._parents
    monkeypatch.setattr(listings, "_round", lambda *a: rounds.append(1) or one(*a))
    jump = graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df: steps.append(1) or jump(df))
    n = 10_000
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("arrival"), F.lit(None).cast("string").alias("place_id"),
                                          F.concat(F.lit("https://m.org/"), F.floor(F.col("id") / 2).cast("string")).alias("maps_url"),
                                          F.concat(F.lit("shop "), F.floor((F.col("id") + 1) / 2).cast("string")).alias("name"), F.lit("1 Road").alias("address"),
                                          F.lit(None).cast("string").alias("domain"))
    got = listings.greedy_dedupe(rows).where("accepted").select("arrival").collect()
    assert sorted(r.arrival for r in got) == list(range(0, n, 2))
    assert len(rounds) + len(steps) / 2 <= 20 and whole is graphs._parents


def test_greedy_in_chains_and_rounds(spark, monkeypatch):
    """Random listings with few keys, decided in rounds, by components, and with components that are too large, as one after the other would be."""
    rng = random.Random(11)
    rows = [(i, rng.choice([None] * 6 + ["ChIJa", "ChIJb"]), rng.choice([None, f"l{rng.randrange(60)}"]), f"n{rng.randrange(25)}", rng.choice([None, f"a{rng.randrange(6)}"]),
             rng.choice([None, f"d{rng.randrange(6)}.org"])) for i in range(400)]
    df = spark.createDataFrame(rows, "arrival long, place_id string, maps_url string, name string, address string, domain string")

    def same(a, b):
        if a[1] and b[1]:
            return a[1] == b[1]
        if a[2] and a[2] == b[2]:
            return True
        if a[3] != b[3]:
            return False
        return a[4] == b[4] if a[4] and b[4] else bool(a[5]) and a[5] == b[5]

    kept = []
    for r in rows:
        if not any(same(r, k) for k in kept):
            kept.append(r)
    for limit, first in ((1 << 17, 3), (1 << 17, 1), (4, 1)):
        monkeypatch.setattr(listings, "FOLDED", limit)
        monkeypatch.setattr(listings, "ROUNDS", first)
        got = listings.greedy_dedupe(df).where("accepted").collect()
        assert sorted(r.arrival for r in got) == [r[0] for r in kept]


def test_demand_over_many_blocks(spark, monkeypatch):
    """More queries of a campaign than a block holds, block of blocks included, against one after the other."""
    monkeypatch.setattr(listings, "BLOCK", 4)
    rng = random.Random(6)
    rows = [(c, q, p, rng.random() < 0.1) for c in (1, 2, 3) for q in range(70) for p in sorted(rng.sample(range(30), rng.randrange(12)))]
    known = {1: 0, 2: 7}
    limit, per_search, want = 25, 20, []
    for c in (1, 2, 3):
        accepted = 0
        for q in range(70):
            if accepted >= limit:
                break
            asked = min(limit - accepted + known.get(c, 0), per_search)
            new = [p for cc, qq, p, is_new in rows if (cc, qq) == (c, q) and is_new and p < asked][:limit - accepted]
            want += [(c, q, p) for p in new]
            accepted += len(new)
    got = listings.remaining_demand(spark.createDataFrame(rows, "campaign_id long, query_no long, position int, is_new boolean"),
                                    spark.createDataFrame(list(known.items()), "campaign_id long, known int"), limit, per_search)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_extracts_people_by_shape(spark):
    text = ("Dr. Jane Smith & Associates\nOur hygienist is Mary Poe.\nKashif Jamal, CEO and founder\n[Dr. Kashif Jamal](x) sees patients. Tom Ray is a receptionist\n"
            "Dr. Lena Brook, BDS\nPrincipal Dentist\nSara Noor\nJunk\nPractice Manager")
    rows = spark.createDataFrame([(1, text, "Kashif Dental Clinic")], "business_id int, text string, business_name string")
    got = {(r.shape, r.name, r.job_title, r.rank) for r in people.extract_people(rows, ["business_id"]).collect()}
    assert got == {(0, "Kashif Jamal", "CEO and founder", 0), (3, "Jane Smith", "Principal (practice named after them)", 1),
                   (4, "Kashif Jamal", "Principal (practice named after them)", 1), (5, "Lena Brook", "Principal Dentist", 0), (5, "Sara Noor", "Practice Manager", 2),
                   (0, "Lena Brook", "BDS", 50)}  # a credential after a comma also reads as a title


def test_confidence_rounds_like_the_double():
    for i in range(1000):
        tie = (i * 10 + 5) / 10000
        assert round(tie, 3) == (i + int(people._HALVES[i])) / 1000


def test_roles_file(spark, tmp_path):
    path = tmp_path / "roles.json"
    path.write_text('{"target_roles": [{"name": "Owner", "role_type": "owner",\n "keywords": ["Co-Founder", "owner"]}], "fallback_roles": [], "exclude_keywords": ["front/desk"]}')
    assert {tuple(r) for r in load_roles(spark, str(path)).collect()} == {
        ("target", 0, "Owner", "owner", "co founder", 0), ("target", 0, "Owner", "owner", "owner", 0), ("excluded", 99, None, "other", "front desk", 0)}


def test_cascade_reaches_grandchildren(spark):
    t = {"campaigns": spark.createDataFrame([(1,), (2,)], "id long"), "businesses": spark.createDataFrame([(10, 1), (20, 2)], "id long, discovery_campaign_id long"),
         "contacts": spark.createDataFrame([(100, 10), (200, 20)], "id long, business_id long"), "emails": spark.createDataFrame([(5, 10, 100, 9), (6, 20, 200, 9)],
                                                                                                                                "id long, business_id long, contact_id long, mailbox_id long"),
         "usage_records": spark.createDataFrame([(7, 10), (8, 20)], "id long, business_id long")}
    left = tables.cascade_delete(t, "campaigns", spark.createDataFrame([(1,)], "id long"))
    assert {n: sorted(tuple(r) for r in df.collect()) for n, df in left.items()} == {
        "campaigns": [(2,)], "businesses": [(20, 2)], "contacts": [(200, 20)], "emails": [(6, 20, 200, 9)], "usage_records": [(7, None), (8, 20)]}
    boxes = {"mailboxes": spark.createDataFrame([(9,)], "id long"), "emails": t["emails"]}
    gone = tables.cascade_delete(boxes, "mailboxes", spark.createDataFrame([(9,)], "id long"))
    assert [r.mailbox_id for r in gone["emails"].collect()] == [None, None]


def test_report_sink(spark, tmp_path):
    from leadloom.sources.report import REPORT_COLUMNS, read_report, usage_log, write_report
    rows = spark.createDataFrame([(1, 2, "a@b.org", "risky", "catch_all", True, True, None, None)],
                                 "contact_id int, business_id int, address string, status string, verdict string, probed boolean, is_catch_all boolean, is_role_account boolean, note string")
    write_report(rows, str(tmp_path / "r"))
    more = rows.union(spark.createDataFrame([(3, 1, "c@d.org", "risky", "x", False, None, False, 'a, "b"\nc')], rows.schema))
    write_report(more, str(tmp_path / "q"))
    assert [tuple(r) for r in read_report(spark, str(tmp_path / "q")).collect()] == [(3, 1, "c@d.org", "risky", "x", False, None, False, 'a, "b"\nc'),
                                                                                     (1, 2, "a@b.org", "risky", "catch_all", True, True, None, "")]
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == list(REPORT_COLUMNS)
    calls = spark.createDataFrame([(None, None, "x" * 300, None)], "action string, model string, detail string, input_tokens long")
    logged = usage_log(calls, str(tmp_path / "u")).first()
    assert (logged.action, logged.model, len(logged.detail), logged.input_tokens) == ("other", "", 255, 0)
