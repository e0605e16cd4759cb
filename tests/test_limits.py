"""Rate limits over tables against plain loops: many partitions, hot keys, dense and sparse times."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.streaming import limits
from test_scale import largest_read
from test_streams import plainly

RULE = ["first_hit", "trailing"]


def judged(rows, limit, window, rule):
    out = {}
    for key in {k for _, k, _ in rows}:
        own = sorted((at, i) for i, k, at in rows if k == key)
        out.update(zip((i for _, i in own), plainly([at for at, _ in own], limit, window, rule)))
    return out


def made(seed, n, steps):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice(steps)
        rows.append((i, rng.choice(["hot"] * 5 + ["a", "b", None, "c", "d"] + [f"k{rng.randrange(200)}"] * 3), at))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", RULE)
@pytest.mark.parametrize("seed,steps,limit", [(1, [0, 1, 2, 5, 70], 3), (2, [1], 4), (3, [0, 0, 0, 1], 1), (4, [90], 2), (5, [0, 3, 400], 10)])
def test_many_partitions(spark, rule, seed, steps, limit):
    """Keys that fill several partitions, busy without a lull or with some; a batch is smaller than a partition."""
    rows = made(seed, 3000, steps)
    df = spark.createDataFrame(rows, "id long, token string, at long").select("id", "token", F.timestamp_seconds("at").alias("ts"))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = limits.rate_limit(df, "token", limit, 60, rule)
        assert got.columns == ["id", "token", "ts", "admitted"]
        assert {r.id: r.admitted for r in got.collect()} == judged(rows, limit, 60, rule)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("rule", RULE)
def test_batches_of_keys(rule):
    """Whole batches at once, with and without a state before, equal one key after the other."""
    rng = random.Random(7)
    for _ in range(300):
        group = np.sort(rng.choices(range(5), k=rng.randrange(1, 60)))
        times = np.concatenate([np.sort(rng.choices(range(0, 300, rng.choice([1, 10])), k=int((group == g).sum()))) for g in np.unique(group)])
        limit, window = rng.randrange(0, 5), rng.choice([5, 40, 100])
        before = limits.RULES[rule](np.sort(np.array(rng.choices(range(-120, 1), k=8))), limit, window, None)[1] if rng.random() < 0.5 else None
        got, state = limits.BATCHES[rule](group, times, limit, window, before)
        want = []
        for number, g in enumerate(np.unique(group)):
            passes, after = limits.RULES[rule](times[group == g], limit, window, before if number == 0 else None)
            want += passes.tolist()
        assert got.tolist() == want and tuple(state) == tuple(after)


def test_tables_of_a_partition():
    rng = random.Random(8)
    for _ in range(300):
        times = np.sort(rng.choices(range(rng.choice([20, 200, 2000])), k=rng.randrange(1, 80)))
        window = rng.choice([3, 30, 300])
        table = limits.end_table(times, window)
        for start in [None, *range(int(times[0]) - window - 5, int(times[0]) + 1)]:
            state = None if start is None else (start, 2)
            _, want = limits.first_hit(times, 1, window, state)
            assert limits.table_end(table, len(times), int(times[-1]), window, state) == want
        assert len(table[0]) <= int(np.searchsorted(times, times[0] + window)) + 1


def test_pointers_stay_in_their_group():
    group, times = np.array([0, 0, 0, 1, 1]), np.array([0, 10, 10, 5, 25])
    assert limits.pointers(group, times, 10).tolist() == [1, 5, 5, 4, 5]
    assert limits.orbit(np.array([1, 3, 3, 5, 5]), np.array([0])).tolist() == [True, True, False, True, False]
    assert limits.last_reached(np.array([1, 3, 3, 5, 5])).tolist() == [3, 3, 3, 3, 4]


@pytest.mark.parametrize("rule", RULE)
def test_no_task_gets_a_hot_key(spark, rule):
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
        rows = spark.range(0, 30_000, 1, 8).select("id", key.alias("token"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
        store = spark.sparkContext._jsc.sc().statusStore()
        seen = largest_read(spark, limits.rate_limit(rows, "token", 3, 600, rule))
        assert all(n < 30_000 / 6 for n in seen), seen
        stages = [s for s in _all(spark, store) if s.shuffleReadRecords() >= 30_000]
        assert stages
        tasks = store.taskList(stages[-1].stageId(), stages[-1].attemptId(), 10_000)
        assert max(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())) < 30_000 / 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _all(spark, store):
    from test_scale import _stages
    return _stages(spark, store)


@pytest.mark.parametrize("rule", RULE)
def test_empty(spark, rule):
    empty = spark.createDataFrame([], "id long, token string, ts timestamp")
    assert limits.rate_limit(empty, "token", 3, 60, rule).count() == 0
