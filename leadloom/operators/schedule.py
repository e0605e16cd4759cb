"""Send times: earliest moment, day loads, what may be queued, and the slot of every approved email."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators import slots
from leadloom.schemas import HOLDS_SLOT, SENT, Settings
from leadloom.session import materialize

STUCK_AFTER = dt.timedelta(minutes=15)


def local_date(moment: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(moment, zone))


def local_day_bounds(day: Column, zone: Column, start: Column | None = None, end: Column | None = None) -> tuple[Column, Column]:
    """UTC start and end of sending on a local day: the window (HH:mm:ss texts), or the whole day."""
    def moment(date: Column, time: Column) -> Column:
        return F.to_utc_timestamp(F.to_timestamp(F.concat(date.cast("string"), F.lit(" "), time)), zone)

    midnight, both = F.lit("00:00:00"), F.lit(False)
    first, last = moment(day, midnight), moment(F.date_add(day, 1), midnight)
    if start is None or end is None:
        return first, last
    both = start.isNotNull() & end.isNotNull()
    return F.when(both, moment(day, start)).otherwise(first), F.when(both, moment(day, end)).otherwise(last)


def local_time(moment: Column, zone: Column) -> Column:
    shown = F.concat(F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd HH:mm"), F.lit(" ("), zone, F.lit(")"))
    return F.coalesce(shown, F.lit("no time yet"))


def is_late(now: dt.datetime) -> Column:
    return F.coalesce(F.col("status").isin("approved", "queued", "failed") & (F.col("scheduled_at") < F.lit(now)), F.lit(False))


def earliest_send(emails: DataFrame, prospects: DataFrame, follow_ups: DataFrame, now: dt.datetime, asked: DataFrame | None = None) -> DataFrame:
    """(id, earliest, problem): now for a first email; for a follow-up the previous send plus its days, not before now.

    ``asked``: the emails whose time is wanted, by default all of them.
    """
    before = emails.select("prospect_id", (F.col("sequence_step") + 1).alias("sequence_step"),
                           F.col("sent_at").alias("previous_sent_at"), F.col("mailbox_id").alias("previous_mailbox_id"))
    flow = prospects.select(F.col("id").alias("prospect_id"), "email_sequence_id")
    days = follow_ups.select(F.col("sequence_id").alias("email_sequence_id"), (F.col("sequence") + 1).alias("sequence_step"),
                             "days_after_previous")
    rows = ((emails if asked is None else asked).select("id", "prospect_id", "sequence_step").join(before, ["prospect_id", "sequence_step"], "left")
            .join(flow, "prospect_id").join(days, ["email_sequence_id", "sequence_step"], "left"))
    first, clock = F.col("sequence_step") <= 1, F.lit(now).cast("timestamp")
    wait = F.make_dt_interval(F.coalesce("days_after_previous", F.lit(0)))
    due = F.greatest(clock, F.col("previous_sent_at") + wait)
    unsent = ~first & F.col("previous_sent_at").isNull()
    return rows.select("id", "prospect_id", "previous_mailbox_id",
                       F.when(first, clock).when(~unsent, due).alias("earliest"),
                       F.when(unsent, "the previous email has not been sent yet").alias("problem"))


def planned_in_day(emails: DataFrame, zone: str = "UTC") -> DataFrame:
    """Emails holding a slot per mailbox and local day (the day is an equality key, not a range join)."""
    held = emails.where(F.col("status").isin(*HOLDS_SLOT) & F.col("scheduled_at").isNotNull())
    return held.groupBy("mailbox_id", local_date(F.col("scheduled_at"), F.lit(zone)).alias("day")).agg(F.count("*").alias("planned"))


def mailbox_load(emails: DataFrame, mailboxes: DataFrame, day: dt.date, cap: int, zone: str = "UTC") -> DataFrame:
    """Planned today against the cap, for every mailbox."""
    today = planned_in_day(emails, zone).where(F.col("day") == F.lit(day)).select("mailbox_id", "planned")
    return (mailboxes.select(F.col("id").alias("mailbox_id"), "is_active").join(today, "mailbox_id", "left")
            .select("mailbox_id", "is_active", F.coalesce("planned", F.lit(0)).alias("planned"), F.lit(cap).alias("cap")))


def can_be_sent(emails: DataFrame, prospects: DataFrame) -> DataFrame:
    """Emails with the first reason they may not go out, or NULL."""
    people = prospects.select(F.col("id").alias("prospect_id"), "do_not_contact", "sequence_stopped_at", "sequence_stop_reason")
    done = emails.where(F.col("status").isin(*SENT, "replied")).select(
        "prospect_id", (F.col("sequence_step") + 1).alias("sequence_step"), F.lit(True).alias("__previous"))
    reason = (F.when(F.col("do_not_contact"), "the prospect is do-not-contact")
              .when(F.col("sequence_stopped_at").isNotNull(), F.concat(
                  F.lit("the prospect's sequence was stopped ("),
                  F.coalesce(F.nullif("sequence_stop_reason", F.lit("")), F.lit("stopped")), F.lit(")")))
              .when((F.col("sequence_step") > 1) & F.col("__previous").isNull(),
                    "the previous email of this follow-up has not been sent"))
    return (emails.join(people, "prospect_id").join(done, ["prospect_id", "sequence_step"], "left")
            .withColumn("reason", reason).select(*emails.columns, "reason"))


def queue_outcome(emails: DataFrame, prospects: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """What queueing each email does: queued (rescheduled first or not), already, or skipped with the reason."""
    active = mailboxes.where("is_active").select(F.col("id").alias("mailbox_id"), F.lit(True).alias("__active"))
    boxes = mailboxes.agg(F.count_if("is_active")).scalar()
    rows = can_be_sent(emails, prospects).join(active, "mailbox_id", "left").withColumn("__boxes", boxes)
    bad_box = F.col("mailbox_id").isNull() | F.col("__active").isNull()
    waiting, queueable = F.col("status").isin("queued", "sending"), F.col("status").isin("approved", "failed")
    why = (F.when(~queueable, F.concat(F.lit("it is "), F.replace(F.col("status"), F.lit("_"), F.lit(" "))))
           .when(F.col("reason").isNotNull(), F.col("reason"))
           .when(bad_box & (F.col("__boxes") == 0), "there is no active mailbox to send from"))
    outcome = F.when(waiting, "already").when(why.isNotNull(), "skipped").otherwise("queued")
    return rows.select("id", outcome.alias("outcome"), F.when(outcome == "skipped", why).alias("reason"),
                       ((outcome == "queued") & (F.col("scheduled_at").isNull() | bad_box)).alias("reschedule"))


def unqueue(emails: DataFrame) -> DataFrame:
    """Queued emails back to approved, keeping their send time."""
    return emails.withColumn("status", F.when(F.col("status") == "queued", "approved").otherwise(F.col("status")))


def next_queued(emails: DataFrame, skip_mailboxes: tuple[int, ...] = (), n: int = 1) -> DataFrame:
    """The queued emails to send next, earliest first, without the mailboxes that cannot send."""
    queue = emails.where(F.col("status") == "queued")
    if skip_mailboxes:
        queue = queue.where(F.col("mailbox_id").isNull() | ~F.col("mailbox_id").isin(*skip_mailboxes))
    return queue.orderBy(F.asc_nulls_last("scheduled_at"), "id").limit(n)


def due_now(emails: DataFrame, now: dt.datetime) -> DataFrame:
    return emails.where((F.col("status") == "queued") & (F.col("scheduled_at") <= F.lit(now)))


def stuck_emails(emails: DataFrame, now: dt.datetime) -> DataFrame:
    return emails.where((F.col("status") == "sending") & (F.col("updated_at") < F.lit(now - STUCK_AFTER)))


def recover_interrupted(emails: DataFrame) -> DataFrame:
    """At a sender's start every email left sending becomes failed: whether it went out is unknown."""
    return emails.withColumn("status", F.when(F.col("status") == "sending", "failed").otherwise(F.col("status")))


def stale_runs(runs: DataFrame, now: dt.datetime, after: dt.timedelta = dt.timedelta(minutes=2)) -> DataFrame:
    """Runs queued too long ago that never started."""
    return runs.where((F.col("status") == "queued") & (F.col("created_at") < F.lit(now - after)))


# ---------------------------------------------------------------- slots


def gap_micros(email_id: Column, settings: Settings, seed: int = 0) -> Column:
    """The fixed gap plus a jitter hashed from the email id, so a retried task draws the same."""
    spread = (settings.gap_random_max_seconds - settings.gap_random_min_seconds) * 1000
    jitter = F.pmod(F.xxhash64(email_id, F.lit(seed)), F.lit(spread + 1)) if spread else F.lit(0)
    fixed = (settings.gap_fixed_seconds + settings.gap_random_min_seconds) * 1000
    return ((jitter + F.lit(fixed)) * 1000).cast("long")


def schedule(requests: DataFrame, mailboxes: DataFrame, holders: DataFrame, settings: Settings) -> DataFrame:
    """Mailbox and send time of every request, handed out in arrival order.

    ``requests``: pool, arrival (unique per pool), email_id, earliest, zone, window_start and
    window_end (seconds of the day, both or neither), previous_mailbox_id, gap_us.
    ``mailboxes``: pool, mailbox_id, priority (active ones; a pool without any gets times only).
    ``holders``: mailbox_id, scheduled_at of emails that already hold a slot.

    Each slot depends on the one before it; ``slots`` says how a pool's requests are handed out in several tasks all the same.
    """
    ordered = requests.select(
        F.col("pool").cast("long").alias("pool"), F.col("arrival").cast("long").alias("position"), F.col("email_id").cast("long").alias("email_id"),
        F.unix_micros("earliest").alias("earliest_us"), "zone", F.col("window_start").cast("int").alias("window_start"), F.col("window_end").cast("int").alias("window_end"),
        F.col("previous_mailbox_id").cast("long").alias("previous_mailbox_id"), F.col("gap_us").cast("long").alias("gap_us"), F.lit(None).cast("string").alias("state"))
    # the pools, the borders of the partitions and the partitions themselves are read from these rows: computed once, kept in reliable storage
    ordered = materialize(ordered)
    first = slots.opening(ordered, mailboxes, holders, settings.daily_cap).withColumn("pool", F.col("pool").cast("long"))
    rows = ordered.unionByName(first, allowMissingColumns=True)
    return slots.hand_out(rows, settings.daily_cap).select("pool", "position", "email_id", "mailbox_id", F.timestamp_micros("slot_us").alias("slot"))
