"""Streams against their batch twins, driven to the end from a folder of small files."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.streaming import opens

BASE = dt.datetime(2024, 1, 1)
HITS = "id long, token string, ip string, ts timestamp"


def hits(n=300, seed=1):
    rng = random.Random(seed)
    at, rows = BASE, []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 2, 5, 70]))
        rows.append((i, "hot" if rng.random() < 0.4 else f"t{rng.randrange(6)}", f"10.0.0.{rng.randrange(3)}", at))
    return rows


def as_stream(spark, rows, schema, tmp_path, files=3):
    folder = str(tmp_path / "in")
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, stream, tmp_path, mode="append"):
    out, name = str(tmp_path / "out"), f"q{random.getrandbits(40)}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    return spark.table(name)


def plainly(times, limit, window, rule):
    """Who passes, straight from the rules: windows cut off one after the other, or all earlier passes looked at."""
    passed = []
    if rule == "trailing":
        for at in times:
            passed.append(sum(ok and at - window < t for t, ok in zip(times, passed)) < limit)
        return passed
    rest = list(times)
    while rest:
        inside = [t for t in rest if t < rest[0] + window]
        passed += [i < limit for i in range(len(inside))]
        rest = rest[len(inside):]
    return passed


def sequential(rows, limit, window, rule):
    ok = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[3], r[0]))
        seconds = [r[3].timestamp() for r in own]
        ok |= dict(zip([r[0] for r in own], plainly(seconds, limit, window, rule)))
    return ok


@pytest.mark.parametrize("rule", ["first_hit", "trailing"])
@pytest.mark.parametrize("step", [1, 7, 1000])
def test_rules_go_on_from_their_state(rule, step):
    rng = random.Random(step)
    for limit in (0, 1, 3):
        times = sorted(rng.choices(range(900), k=400))
        state, got = None, []
        for i in range(0, len(times), step):
            passes, state = opens.RULES[rule](np.array(times[i:i + step]), limit, 60, state)
            got += passes.tolist()
        assert got == plainly(times, limit, 60, rule)


@pytest.mark.parametrize("rule", ["first_hit", "trailing"])
@pytest.mark.parametrize("quiet", [70, 5])
def test_batch_twin_is_the_sequential_rule(spark, rule, quiet):
    rows = [r for r in hits()] if quiet == 70 else [(i, "hot", "x", BASE + dt.timedelta(seconds=i // 2)) for i in range(600)]
    rows += [(10_000 + i, None, "x", BASE + dt.timedelta(seconds=i)) for i in range(10)]  # a NULL key is a key
    got = opens.rate_limit(spark.createDataFrame(rows, HITS).select("id", "token", "ts"), "token", 3, 60, rule)
    assert {r.id: r.admitted for r in got.collect()} == sequential(rows, 3, 60, rule)


@pytest.mark.parametrize("rule", ["first_hit", "trailing"])
def test_stream_equals_batch(spark, rule, tmp_path):
    rows = hits()
    stream = opens.limited_stream(as_stream(spark, rows, HITS, tmp_path), "token", 3, 60, rule)
    assert {r.id: r.admitted for r in drained(spark, stream, tmp_path).collect()} == sequential(rows, 3, 60, rule)


def test_twenty_opens_in_a_minute_count_ten(spark):
    emails = spark.createDataFrame([(1, "a", BASE, "sent"), (2, "b", None, "approved"), (3, "c", BASE, "failed")], "id long, tracking_token string, sent_at timestamp, status string")
    seen = [(i, "a", "ip", BASE + dt.timedelta(seconds=i)) for i in range(20)] + [(30, "a", "ip", BASE + dt.timedelta(seconds=75)), (31, "b", "ip", BASE), (32, "zz", "ip", BASE), (33, "c", "ip", BASE)]
    counted = opens.recorded_opens(spark.createDataFrame(seen, HITS), emails)
    assert sorted(r.id for r in counted.collect()) == [*range(10), 30, 33]
    rolled = {r.id: (r.status, r.open_count) for r in opens.open_rollup(emails, counted).collect()}
    assert rolled == {1: ("opened", 11), 2: ("approved", 0), 3: ("failed", 1)}


def test_recorded_stream(spark, tmp_path):
    emails = spark.createDataFrame([(1, "hot", BASE), (2, "t1", None), (3, "t2", BASE)], "id long, tracking_token string, sent_at timestamp")
    rows = hits()
    stream = opens.record_opens(as_stream(spark, rows, HITS, tmp_path), emails, 3, 60)
    batch = opens.recorded_opens(spark.createDataFrame(rows, HITS), emails, 3, 60)
    assert sorted(r.id for r in drained(spark, stream, tmp_path).collect()) == sorted(r.id for r in batch.collect())


def test_both_limits_stream(spark, tmp_path):
    rows = hits()
    stream = opens.limited_requests_stream(as_stream(spark, rows, HITS, tmp_path, files=1), 20, 3, 60)
    batch = opens.limit_requests(spark.createDataFrame(rows, HITS), 20, 3, 60).where("admitted")
    assert sorted(r.id for r in drained(spark, stream, tmp_path).collect()) == sorted(r.id for r in batch.collect())


def test_the_whole_job(spark, tmp_path):
    """Requests delivered twice, over the limits, of unknown tokens and of emails not sent; the state goes when its time is over."""
    tokens = {f"k{i}": f"{i}" * 43 for i in range(4)}
    emails = spark.createDataFrame([(i, tokens[f"k{i}"], BASE if i < 3 else None) for i in range(4)], "id long, tracking_token string, sent_at timestamp")
    rng = random.Random(8)
    rows = [(i, "GET", f"/footer/{tokens[rng.choice(list(tokens))]}.png", f"10.0.0.{rng.randrange(2)}", "", "ua", BASE + dt.timedelta(seconds=3 * i)) for i in range(400)]
    rows += [(5000, "GET", "/footer/" + "z" * 43, "9.9.9.9", "", "ua", BASE + dt.timedelta(hours=3)), (5001, "GET", "/footer/" + "z" * 43, "9.9.9.9", "", "ua", BASE + dt.timedelta(hours=6))]
    schema = "id long, method string, path string, forwarded_for string, real_ip string, user_agent string, ts timestamp"
    stream = as_stream(spark, [r for r in rows[:400] for _ in range(2)] + rows[400:], schema, tmp_path, files=2)
    query = opens.track_opens(stream, emails, str(tmp_path / "rollups"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    read = opens.read_open_requests(spark.createDataFrame(rows, schema))
    batch = opens.recorded_opens(opens.limit_requests(read).where("admitted").drop("admitted"), emails)
    want = {r.email_id: (r.n, r.first, r.last) for r in batch.groupBy("email_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).collect()}
    got = {r.email_id: (r.open_count, r.first_opened_at, r.last_opened_at) for r in opens.read_rollup(spark, str(tmp_path / "rollups")).collect()}
    assert got == want and len(want) == 3
    left = [s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"]]
    most = [max(p["stateOperators"][i]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) for i in range(len(left))]
    assert sum(left) < sum(most)


def test_rollup_merges_batches(spark):
    rows = [(1, BASE), (1, BASE + dt.timedelta(hours=1)), (2, BASE)]
    first, second = (spark.createDataFrame(part, "email_id long, ts timestamp") for part in (rows[:1], rows[1:]))
    empty = spark.createDataFrame([], "email_id long, first_opened_at timestamp, last_opened_at timestamp, open_count long")
    merged = opens.merge_rollup(opens.merge_rollup(empty, first), second)
    assert {r.email_id: r.open_count for r in merged.collect()} == {1: 2, 2: 1}


def test_requests_duplicates_and_usage(spark, tmp_path):
    schema = "id long, created_at timestamp, action string, model string, input_tokens long, output_tokens long, credits decimal(8,2)"
    rows = [(i, BASE + dt.timedelta(hours=9 * i), "research", "m", 10, 1, None) for i in range(8)]
    totals = drained(spark, opens.usage_stream(as_stream(spark, rows, schema, tmp_path)), tmp_path, "complete").collect()
    assert sorted((r.day.day, r.calls, r.input_tokens) for r in totals) == [(1, 3, 30), (2, 3, 30), (3, 2, 20)]
    again = [(1, "a", "x", BASE), (1, "a", "x", BASE), (2, "a", "x", BASE)]
    other = tmp_path / "d"
    other.mkdir()
    assert sorted(r.id for r in drained(spark, opens.deduplicated(as_stream(spark, again, HITS, other, files=2)), other).collect()) == [1, 2]


def test_reply_window_runs_out(spark, tmp_path):
    day = lambda n: BASE + dt.timedelta(days=n)
    rows = [(1, "sent", day(0)), (2, "sent", day(0)), (2, "replied", day(1)), (3, "sent", day(0)), (3, "sent", day(2)), (9, "tick", day(4)), (9, "tick", day(4.5)), (9, "tick", day(4.6))]
    stream = opens.reply_timeouts(as_stream(spark, rows, "prospect_id long, kind string, ts timestamp", tmp_path, files=8))
    got = drained(spark, stream, tmp_path).select("prospect_id", F.date_format("expired_at", "yyyy-MM-dd").alias("d")).collect()
    assert [tuple(r) for r in got] == [(1, "2024-01-04")]


def test_stale_and_abandoned_runs(spark, tmp_path):
    """As the batch rule at the end of the stream says, each found when the watermark passes its time."""
    from leadloom.operators.schedule import stale_runs
    at = lambda m: BASE + dt.timedelta(minutes=m)
    rows = [(1, "queued", at(0)), (2, "queued", at(0)), (2, "running", at(1)), (3, "queued", at(1)), (2, "running", at(8)), (4, "running", at(3)), (4, "done", at(9)), (9, "tick", at(30)),
            (9, "tick", at(31)), (9, "tick", at(32))]
    schema = "id long, status string, ts timestamp"
    folders = [tmp_path / n for n in ("stale", "abandoned")]
    for f in folders:
        f.mkdir()
    got = drained(spark, opens.stale_runs_stream(as_stream(spark, rows, schema, folders[0], files=10)), folders[0]).collect()
    last = {i: (s, t) for i, s, t in rows[:7]}
    table = spark.createDataFrame([(i, s, t) for i, (s, t) in last.items()], "id long, status string, created_at timestamp")
    assert sorted(r.id for r in got) == sorted(r.id for r in stale_runs(table, at(30)).collect()) == [1, 3]
    assert {r.id: r.expired_at for r in got} == {1: at(2), 3: at(3)}
    got = drained(spark, opens.abandoned_runs_stream(as_stream(spark, rows, schema, folders[1], files=10)), folders[1]).collect()
    assert {r.id: r.expired_at for r in got} == {2: at(18)}


def test_due_emails_are_handed_out(spark, tmp_path):
    """Every tick hands out what is due at that moment, earliest first; a restarted stream goes on."""
    import threading
    schema = "id long, status string, scheduled_at timestamp"
    queue = [(3, "queued", BASE), (1, "queued", BASE), (2, "queued", dt.datetime(2999, 1, 1)), (4, "sent", BASE), (5, "queued", BASE - dt.timedelta(days=1))]
    seen, told = [], threading.Event()

    def send(rows, epoch):
        seen.append((epoch, [r.id for r in rows.collect()]))
        told.set()

    ticks = tmp_path / "ticks"
    for turn in range(2):
        spark.range(1).select(F.lit(turn).alias("n")).coalesce(1).write.mode("append").parquet(str(ticks))
        stream = spark.readStream.schema("n int").parquet(str(ticks))
        start = opens.due_emails_writer(lambda: spark.createDataFrame(queue, schema), send, str(tmp_path / "cp"), every="1 second")
        told.clear()
        query = start(stream)
        try:
            assert told.wait(60)
        finally:
            query.stop()
    assert [ids for _, ids in seen] == [[5, 1, 3]] * len(seen) and [e for e, _ in seen] == list(range(len(seen))) and len(seen) >= 2


def test_open_requests(spark):
    token = "t" * 43
    rows = [("GET", f"/email/footer/{token}.png"), ("GET", f"/footer/{token}/"), ("POST", f"/footer/{token}"), ("GET", "/footer/short"), ("GET", f"/footer/{token}/x"), ("GET", f"/footer/%74{token[1:]}")]
    df = spark.createDataFrame([(i, m, p, " 1.2.3.4 , 5.6.7.8" if i else "", "9.9.9.9", "a" * 600, BASE) for i, (m, p) in enumerate(rows)],
                               "id int, method string, path string, forwarded_for string, real_ip string, user_agent string, ts timestamp")
    got = opens.read_open_requests(df).collect()
    assert [(r.id, r.token == token, r.ip, len(r.user_agent)) for r in got] == [(0, True, "9.9.9.9", 500), (1, True, "1.2.3.4", 500), (5, True, "1.2.3.4", 500)]
