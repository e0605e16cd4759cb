"""The ordered primitives on skewed keys, against plain windows; and the plans that keep skew apart."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.operators.reports import board
from leadloom.scale import join_summary, positions, running, top_k, with_block


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 60), i, rng.choice([None, *range(5)])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, id long, score int")


def test_positions_equal_row_number(spark):
    df = skewed(spark)
    order = [F.desc_nulls_last("score"), F.col("id")]
    levels = [-F.coalesce("score", F.lit(-1)), F.col("__part")]
    got = positions(with_block(df, F.col("id"), blocks=32), ["k"], order, levels)
    expected = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy(*order)) - 1)
    assert got.join(expected.select("id", "want"), "id").where(F.col("position") != F.col("want")).isEmpty()
    assert got.count() == df.count()


def test_running_equals_window(spark):
    df = skewed(spark)
    for before in (False, True):
        got = running(with_block(df, F.col("id"), blocks=32), ["k"], F.col("__part"), [F.col("id")], before=before,
                      sums={"total": F.coalesce("score", F.lit(0))}, lasts={"latest": F.col("score")})
        frame = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        want = df.select("id", F.coalesce(F.sum(F.coalesce("score", F.lit(0))).over(frame), F.lit(0)).alias("t"),
                         F.last("score", ignorenulls=True).over(frame).alias("l"))
        wrong = got.join(want, "id").where(~F.col("total").eqNullSafe(F.col("t")) | ~F.col("latest").eqNullSafe(F.col("l")))
        assert wrong.isEmpty() and got.count() == df.count()


def test_blocks_are_counted_however_ids_lie(spark):
    """Dense ids, ids far apart, and ids that lie in two heaps: no block holds much more than its share."""
    for id_ in (F.col("id"), F.col("id") * (1 << 21), F.when(F.col("id") < 90_000, F.col("id")).otherwise(F.col("id") * (1 << 40))):
        ids = spark.range(100_000).select(id_.alias("id"))
        sizes = with_block(ids, F.col("id"), name="b", blocks=256).groupBy("b").count().agg(F.max("count"), F.count("b")).first()
        assert sizes[0] <= 2 * 100_000 / 256 and 200 <= sizes[1] <= 256
    empty = spark.range(0)
    assert with_block(empty, F.col("id")).count() == 0


def test_sparse_ids_and_null_keys(spark):
    df = skewed(spark).select(F.when(F.col("k") > 3, F.col("k")).alias("k"), (F.col("id") * (1 << 33)).alias("id"), "score")
    df = with_block(df, F.col("id"), blocks=32)
    got = positions(df, ["k"], [F.col("id")], [F.col("__part")])
    want = df.select(F.col("id"), (F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1).alias("w"))
    assert got.join(want, "id").where(F.col("w") != F.col("position")).isEmpty() and got.count() == df.count()
    total = running(df, ["k"], F.col("__part"), [F.col("id")], sums={"n": F.lit(1)})
    assert total.count() == df.count() and total.where(F.col("k").isNull()).agg(F.max("n")).first()[0] == df.where("k IS NULL").count()


def test_top_k_limits_before_the_shuffle(spark):
    plan = top_k(skewed(spark), ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial in the map tasks, final after the shuffle


def test_board_counts_everything_but_keeps_k(spark):
    leads = skewed(spark).select("id", F.lit("lost").alias("stage"), F.lit(None).cast("timestamp").alias("stage_changed_at"))
    rows = board(leads, 5).collect()
    assert len(rows) == 5 and {(r.total, r.more) for r in rows} == {(3000, 2995)}


def test_summary_join(spark):
    rows = spark.createDataFrame([(k, i, str(i)) for i, k in enumerate([7] * 500 + [None] * 300 + list(range(20, 3000)))], "k int, id int, v string")
    summary = rows.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    got = join_summary(rows, summary, ["k"], "n")
    assert got.columns == ["k", "id", "v", "least"]
    want = rows.withColumn("least", F.min("id").over(Window.partitionBy("k")))
    assert got.exceptAll(want).isEmpty() and got.count() == rows.count()
    some = summary.where("k < 100 OR k IS NULL")
    assert join_summary(rows, some, ["k"], "n", how="inner").count() == 500 + 300 + 80
    assert join_summary(rows, some, ["k"], "n").where("least IS NULL").count() == rows.count() - 880


def hot(n=30_000):
    """A third of the rows on one key, one in ten without a key."""
    return F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))


def test_no_task_gets_a_hot_key(spark):
    """The operators that join rows to a summary of their key, on a key with a third of the rows, without any broadcast of Spark's own."""
    from leadloom.operators import listings, tables, verify
    from leadloom.operators.outreach import ready_prospects
    from leadloom.operators.people import waterfall

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        base = spark.range(0, 30_000, 1, 8).withColumn("key", hot())
        prompts = base.select("id", F.lit(1).alias("owner_id"), F.lit("o").alias("owner"), F.coalesce("key", F.lit("none")).alias("name"), F.lit(0).alias("sequence"), F.lit("a").alias("variation"),
                              F.lit(False).alias("is_default"), F.lit(0).alias("opened"))
        url = F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:ChIJ"), F.rpad(F.regexp_replace(F.coalesce("key", F.lit("none")), "[^a-z0-9]", ""), 23, "x"))
        businesses = base.select("id", F.lit(None).cast("string").alias("google_place_id"), url.alias("google_maps_url"))
        checks = base.select(F.col("id").alias("position"), F.concat(F.lit("a@"), F.coalesce("key", F.lit("none")), F.lit(".example")).alias("address"), F.lit(True).alias("answered"),
                             (F.col("id") % 7 == 0).alias("is_catch_all"), F.lit(True).alias("can_connect_smtp"), F.lit(False).alias("retryable"), F.lit("deliverable").alias("status"),
                             F.lit("ok").alias("verdict"), F.lit("").alias("note"))
        prospects = base.select("id", "key", F.col("key").alias("email"), F.xxhash64("key").alias("contact_id"), F.lit("deliverable").alias("email_status"), F.lit(False).alias("approved_by_person"),
                                F.lit("ready").alias("outreach_status"), F.lit(False).alias("do_not_contact"), F.lit(None).cast("timestamp").alias("sequence_stopped_at"), F.lit(None).cast("string").alias("pipeline_stage"))
        emails = spark.createDataFrame([], "prospect_id long")
        known = spark.createDataFrame([], "domain string")
        crowd = prospects.withColumn("business_id", F.xxhash64("key")).withColumn("verdict", F.lit("ok"))
        evidence = base.select("id", F.xxhash64("key").alias("business_id"), (F.col("id") % 3).alias("tier"), F.when(F.col("id") % 5 == 0, "target").otherwise("fallback").alias("kind"))
        # one listing in three has the hot name and address, every one a link of its own; half of them are saved
        listed = listings.identify(base.select(F.col("id").alias("arrival"), (F.col("id") % 7).alias("campaign_id"), F.lit(None).cast("string").alias("place_id"),
                                               F.concat(F.lit("https://m.org/"), F.col("id").cast("string")).alias("maps_url"), F.coalesce("key", F.lit("none")).alias("name"),
                                               F.lit("1 Road").alias("address"), F.lit(None).cast("string").alias("domain")))
        saved = listed.where(F.col("arrival") % 2 == 0).withColumnRenamed("arrival", "id")
        for name, df in {"prompts": tables.prompts_to_kinds(prompts), "shortcuts": verify.shortcut_domains(checks, known),
                         "places": listings.backfill_place_ids(businesses), "ready": ready_prospects(prospects, emails),
                         "siblings": verify.sibling_addresses(crowd), "waterfall": waterfall(evidence)}.items():
            read = largest_read(spark, df)
            assert read and max(read) < 30_000 / 6, (name, read)
        # several keys a listing: more rows than listings, of which no task gets more than twice its share
        shares = largest_read(spark, listings.first_match(listed.where(F.col("arrival") % 2 == 1), saved), shares=True)
        assert shares and max(shares) < 2 / 16, shares
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def largest_read(spark, df, shares=False):
    """Rows that the fullest task of each shuffled stage read, of joins and windows, from the executed plan's metrics; or its share of the stage's rows."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in _stages(spark, store)}
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out = []
    for stage in _stages(spark, store):
        if stage.stageId() not in before and stage.shuffleReadRecords() > 5000:
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            most = max(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()))
            out.append(most / stage.shuffleReadRecords() if shares else most)
    return out


def _stages(spark, store):
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    found = store.stageList(None, False, False, none, None)
    return [found.apply(i) for i in range(found.size())]
