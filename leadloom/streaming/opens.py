"""Open tracking: image requests, rate limits and open counts, as streams and as batch twins.

Both limits depend on what was admitted before, so neither is a window function; ``limits`` says how tables are judged.
In streams a key's rows of a micro-batch are decided by jumps to the next moment at which something changes, so the work is a
search per window or admitted row, not a step per row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadloom.functions.templates import TOKEN_PATTERN
from leadloom.streaming.limits import RULES, rate_limit

# The image path with its token, the limits, and how much of a user agent is kept.
FOOTER_PATH = r"/footer/([^/]+?)(?:\.(?:png|gif|jpe?g|webp))?/?$"
PER_IP, PER_TOKEN, OPENS_PER_EMAIL, WINDOW_SECONDS, MAX_USER_AGENT = 60, 10, 10, 60, 500


def read_open_requests(requests: DataFrame) -> DataFrame:
    """Image requests (method, path, forwarded_for, real_ip, user_agent, ts) with a usable token.

    Stateless, so the same for a stream and a table.
    """
    token = F.try_url_decode(F.replace(F.regexp_extract("path", FOOTER_PATH, 1), F.lit("+"), F.lit("%2B")))
    ip = F.coalesce(F.nullif(F.trim(F.split_part("forwarded_for", F.lit(","), F.lit(1))), F.lit("")), F.nullif("real_ip", F.lit("")), F.lit("unknown"))
    kept = [c for c in requests.columns if c not in ("method", "path", "forwarded_for", "real_ip", "user_agent")]
    return (requests.where(F.col("method") == "GET")
            .select(*kept, token.alias("token"), ip.alias("ip"),
                    F.left(F.coalesce("user_agent", F.lit("")), F.lit(MAX_USER_AGENT)).alias("user_agent"))
            .where(F.col("token").rlike(TOKEN_PATTERN)))


def limit_requests(rows: DataFrame, per_ip: int = PER_IP, per_token: int = PER_TOKEN, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Requests (id, ip, token, ts) with ``admitted``: both counters advance before either decides."""
    by_ip = rate_limit(rows.select("id", "ip", "ts"), "ip", per_ip, window_seconds, "first_hit").select("id", F.col("admitted").alias("__ip"))
    by_token = rate_limit(rows.select("id", "token", "ts"), "token", per_token, window_seconds, "first_hit").select("id", F.col("admitted").alias("__token"))
    return rows.join(by_ip, "id").join(by_token, "id").withColumn("admitted", F.col("__ip") & F.col("__token")).drop("__ip", "__token")


def sent_opens(opens: DataFrame, emails: DataFrame) -> DataFrame:
    """Opens (token) of emails that were sent; unknown tokens and unsent emails record nothing."""
    sent = emails.where(F.col("sent_at").isNotNull()).select(F.col("id").alias("email_id"), F.col("tracking_token").alias("token"))
    return opens.join(sent, "token")


def recorded_opens(opens: DataFrame, emails: DataFrame, limit: int = OPENS_PER_EMAIL, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Batch twin of record_opens: the opens (id, token, ts) that count."""
    return rate_limit(sent_opens(opens, emails), "email_id", limit, window_seconds, "trailing").where("admitted").drop("admitted")


def open_rollup(emails: DataFrame, opens: DataFrame) -> DataFrame:
    """Emails with first and last open, count, and sent turned opened (other statuses are kept)."""
    counted = opens.groupBy("email_id").agg(F.min("ts").alias("first_opened_at"), F.max("ts").alias("last_opened_at"), F.count("*").alias("open_count"))
    joined = emails.join(counted, emails.id == counted.email_id, "left").drop("email_id")
    return joined.withColumns({
        "status": F.when((F.col("status") == "sent") & F.col("open_count").isNotNull(), "opened").otherwise(F.col("status")),
        "open_count": F.coalesce("open_count", F.lit(0))})


def _rolled(opens: DataFrame) -> DataFrame:
    return opens.groupBy("email_id").agg(F.min("ts").alias("first_opened_at"), F.max("ts").alias("last_opened_at"), F.count("*").alias("open_count"))


def merge_rollup(stored: DataFrame, batch: DataFrame, rolled: bool = False) -> DataFrame:
    """A stored rollup (email_id, first_opened_at, last_opened_at, open_count) with one micro-batch of opens, or a rollup of such, added."""
    new = batch if rolled else _rolled(batch)
    return stored.unionByName(new).groupBy("email_id").agg(
        F.min("first_opened_at").alias("first_opened_at"), F.max("last_opened_at").alias("last_opened_at"), F.sum("open_count").alias("open_count"))


# ---------------------------------------------------------------- streams


def _micros(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64")).tolist()


class LimitProcessor(StatefulProcessor):
    """Per key what its rule remembers: a few numbers, which go when the watermark is a window past the key's last row.

    The rows of a key in one micro-batch are put in order of (ts, id); a micro-batch's size is what
    bounds them (set the source's maximum per trigger).
    """

    def __init__(self, rule: str, limit: int, window_seconds: int):
        self.rule, self.limit, self.window_us = rule, limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        shape = T.StructType([T.StructField("numbers", T.ArrayType(T.LongType())), T.StructField("due", T.LongType())])
        self.state = handle.getValueState("window", shape)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"], kind="stable")
        held, due = self.state.get() if self.state.exists() else (None, None)
        times = np.array(_micros(batch["ts"]), np.int64)
        passes, held = RULES[self.rule](times, self.limit, self.window_us, tuple(held) if held else None)
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(due or 0, (int(times[-1]) + self.window_us) // 1000 + 1)
        self.handle.registerTimer(due)
        self.state.update((list(held or ()), due))
        yield batch.assign(admitted=passes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited_stream(stream: DataFrame, key: str, limit: int, window_seconds: int, rule: str, delay: str | None = "10 minutes") -> DataFrame:
    """Stream rows (id, ts, key, ...) with ``admitted``; rows of one key are judged in arrival order,
    inside a micro-batch in order of (ts, id). Rows later than the watermark are dropped; without
    ``delay`` the stream must have one on ``ts`` already."""
    rows = stream.withWatermark("ts", delay) if delay else stream
    shape = T.StructType([*stream.schema.fields, T.StructField("admitted", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=LimitProcessor(rule, limit, window_seconds), outputStructType=shape, outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="ts")


def limited_requests_stream(stream: DataFrame, per_ip: int = PER_IP, per_token: int = PER_TOKEN,
                            window_seconds: int = WINDOW_SECONDS, delay: str | None = "10 minutes") -> DataFrame:
    """Requests both limits let through; the token counter also advances for those the IP limit stops."""
    by_ip = limited_stream(stream, "ip", per_ip, window_seconds, "first_hit", delay).withColumnRenamed("admitted", "ip_ok")
    both = limited_stream(by_ip, "token", per_token, window_seconds, "first_hit", delay=None)
    return both.where(F.col("ip_ok") & F.col("admitted")).drop("ip_ok", "admitted")


def record_opens(stream: DataFrame, emails: DataFrame, limit: int = OPENS_PER_EMAIL, window_seconds: int = WINDOW_SECONDS,
                 delay: str | None = "10 minutes") -> DataFrame:
    """Opens (id, token, ts) that count: of sent emails, at most ``limit`` per email and trailing window."""
    counted = limited_stream(sent_opens(stream, emails), "email_id", limit, window_seconds, "trailing", delay)
    return counted.where("admitted").drop("admitted")


def once(rows: DataFrame) -> DataFrame:
    """Batch twin of deduplicated: each event id once."""
    return rows.dropDuplicates(["id"])


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event id once; events later than the watermark are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def track_opens(requests: DataFrame, emails: DataFrame, rollups: str, checkpoint: str, delay: str = "10 minutes", **trigger):
    """The whole job, started: image requests (id, method, path, ...) read, told apart by id, limited, recorded, rolled up.

    ``rollups`` and ``checkpoint`` are folders that all machines share. Every micro-batch writes the
    rollup of its own opens into a folder of its number, so one that is run again replaces itself;
    ``read_rollup`` adds them up. ``trigger`` as for ``writeStream.trigger``.
    """
    passed = limited_requests_stream(deduplicated(read_open_requests(requests), delay), delay=None)
    counted = record_opens(passed, emails, delay=None)

    def add(batch: DataFrame, number: int) -> None:
        _rolled(batch).write.mode("overwrite").parquet(f"{rollups}/batch={number}")

    return counted.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "10 seconds"}).start()


def read_rollup(spark: SparkSession, rollups: str) -> DataFrame:
    """First and last open and count of every email, over all micro-batches."""
    none = spark.createDataFrame([], "email_id long, first_opened_at timestamp, last_opened_at timestamp, open_count long")
    return merge_rollup(none, spark.read.schema(none.schema).parquet(rollups).select(*none.columns), rolled=True)


def usage_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily totals per action and model of usage records (created_at, action, model, tokens, credits)."""
    return (stream.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day"), "action", "model")
            .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                 F.sum("credits").alias("credits"), F.count("*").alias("calls"))
            .select(F.col("window.start").alias("day"), "action", "model", "input_tokens", "output_tokens", "credits", "calls"))


class Silence(StatefulProcessor):
    """Per key: expire when nothing came for some time after a row of one of the ``starts`` kinds."""

    def __init__(self, seconds: float, starts: tuple[str, ...], key: str, kind: str):
        self.wait_ms, self.starts, self.key, self.kind = int(seconds * 1000), starts, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("due", T.StructType([T.StructField("due", T.LongType())]))

    def _cancel(self) -> None:
        if self.state.exists():
            self.handle.deleteTimer(self.state.get()[0])
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        for kind, at in zip(batch[self.kind], _micros(batch["ts"])):
            self._cancel()  # any sign ends a wait
            if kind in self.starts:
                due = at // 1000 + self.wait_ms
                self.handle.registerTimer(due)
                self.state.update((due,))
        yield pd.DataFrame({self.key: pd.Series(dtype="int64"), "expired_at": pd.Series(dtype="datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "expired_at": pd.to_datetime([due], unit="ms").astype("datetime64[us]")})

    def close(self) -> None:
        pass


def _silent(stream: DataFrame, key: str, kind: str, starts: tuple[str, ...], seconds: float, delay: str) -> DataFrame:
    shape = T.StructType([T.StructField(key, T.LongType()), T.StructField("expired_at", T.TimestampType())])
    return stream.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Silence(seconds, starts, key, kind), outputStructType=shape, outputMode="Append", timeMode="EventTime")


def reply_timeouts(stream: DataFrame, reply_window_days: int = 3, delay: str = "0 seconds") -> DataFrame:
    """Leads without any sign for the reply window after a send: (prospect_id, expired_at).

    ``stream``: prospect_id, kind (sent, or anything that ends the wait: a reply, a stop, a further email), ts.
    """
    return _silent(stream, "prospect_id", "kind", ("sent",), reply_window_days * 86_400, delay)


def stale_runs_stream(stream: DataFrame, after: dt.timedelta = dt.timedelta(minutes=2), delay: str = "0 seconds") -> DataFrame:
    """Runs queued that never started in time: (id, expired_at). Stream twin of ``schedule.stale_runs``; ``stream``: id, status, ts of every change."""
    return _silent(stream, "id", "status", ("queued",), after.total_seconds(), delay)


def abandoned_runs_stream(stream: DataFrame, after: dt.timedelta = dt.timedelta(minutes=10), delay: str = "0 seconds") -> DataFrame:
    """Runs that showed no progress for so long: (id, expired_at). ``stream``: id, status (running with every sign of progress), ts."""
    return _silent(stream, "id", "status", ("running",), after.total_seconds(), delay)


def due_emails_writer(queue_table, send_batch, checkpoint: str, every: str = "30 seconds"):
    """Start a stream that looks at the queue every 30 seconds and hands what is due to ``send_batch``.

    ``checkpoint`` is a folder that all machines share; a restarted stream goes on from there.

    ``queue_table`` is a function returning the queue as it is now; only the selection is ours.
    """
    from leadloom.operators.schedule import due_now

    def look(batch: DataFrame, epoch: int) -> None:
        now = batch.sparkSession.range(1).select(F.current_timestamp().alias("n")).first()["n"]
        send_batch(due_now(queue_table(), now).orderBy("scheduled_at", "id"), epoch)

    def start(ticks: DataFrame):
        return ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    return start


