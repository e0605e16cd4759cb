"""Send-time queries."""

from pyspark.sql import functions as F

from leadloom.operators import schedule
from leadloom.plans.registry import query
from leadloom.plans.reporting import NOW
from leadloom.schemas import HOLDS_SLOT, Settings
from leadloom.session import materialize

_FORMAT = "yyyy-MM-dd HH:mm:ss"
_NOW = "timestamp '2024-01-02 12:00:00'"


@query("planned_per_mailbox_day", "J12", """
SELECT mailbox_id, strftime(scheduled_at + interval 5 hour, '%Y-%m-%d') AS day, count(*) AS planned FROM {v_emails}
WHERE status IN ('approved', 'queued', 'sending', 'sent', 'opened', 'replied') GROUP BY 1, 2""")
def planned_per_mailbox_day(v):
    return schedule.planned_in_day(v.v_emails, "Asia/Karachi").withColumn("day", F.col("day").cast("string"))


@query("mailbox_load", "A12 J12", """
SELECT m.id AS mailbox_id, m.is_active, count(e.id) AS planned, 40 AS cap FROM {v_mailboxes} m LEFT JOIN {v_emails} e ON e.mailbox_id = m.id
 AND strftime(e.scheduled_at, '%Y-%m-%d') = '1997-06-02' AND e.status IN ('approved', 'queued', 'sending', 'sent', 'opened', 'replied') GROUP BY 1, 2""")
def mailbox_load(v):
    import datetime as dt
    return schedule.mailbox_load(v.v_emails, v.v_mailboxes, dt.date(1997, 6, 2), 40)


@query("earliest_send", "W9 J8", f"""
SELECT e.id, CASE WHEN e.sequence_step = 1 THEN strftime({_NOW}, '%Y-%m-%d %H:%M:%S') WHEN b.sent_at IS NOT NULL
  THEN strftime(greatest({_NOW}, b.sent_at + to_days(coalesce(f.days_after_previous, 0))), '%Y-%m-%d %H:%M:%S') END AS earliest,
 CASE WHEN e.sequence_step > 1 AND b.sent_at IS NULL THEN 'the previous email has not been sent yet' END AS problem
FROM {{v_emails}} e JOIN {{v_prospects}} p ON p.id = e.prospect_id
LEFT JOIN {{v_emails}} b ON b.prospect_id = e.prospect_id AND b.sequence_step = e.sequence_step - 1
LEFT JOIN {{v_follow_ups}} f ON f.sequence_id = p.email_sequence_id AND f.sequence = e.sequence_step - 1""")
def earliest_send(v):
    return schedule.earliest_send(v.v_emails, v.v_prospects, v.v_follow_ups, NOW).select(
        "id", F.date_format("earliest", _FORMAT).alias("earliest"), "problem")


_REASON = """CASE WHEN p.do_not_contact THEN 'the prospect is do-not-contact'
 WHEN p.sequence_stopped_at IS NOT NULL THEN 'the prospect''s sequence was stopped (' || coalesce(p.sequence_stop_reason, 'stopped') || ')'
 WHEN e.sequence_step > 1 AND NOT EXISTS (SELECT 1 FROM {v_emails} b WHERE b.prospect_id = e.prospect_id AND b.sequence_step = e.sequence_step - 1
   AND b.status IN ('sent', 'opened', 'replied')) THEN 'the previous email of this follow-up has not been sent' END"""


@query("can_be_sent", "F15", f"SELECT e.id, {_REASON} AS reason FROM {{v_emails}} e JOIN {{v_prospects}} p ON p.id = e.prospect_id")
def can_be_sent(v):
    return schedule.can_be_sent(v.v_emails, v.v_prospects).select("id", "reason")


@query("queue_outcome", "F16 M2", f"""
SELECT id, CASE WHEN NOT ok THEN 'skipped' WHEN reason IS NOT NULL THEN 'skipped' ELSE 'queued' END AS outcome,
 CASE WHEN NOT ok THEN 'it is ' || replace(status, '_', ' ') ELSE reason END AS reason, ok AND reason IS NULL AND mailbox_id = 3 AS reschedule
FROM (SELECT e.id, e.status, e.mailbox_id, e.status IN ('approved', 'failed') AS ok, {_REASON} AS reason
      FROM {{v_emails}} e JOIN {{v_prospects}} p ON p.id = e.prospect_id) x""")
def queue_outcome(v):
    return schedule.queue_outcome(v.v_emails, v.v_prospects, v.v_mailboxes)


# A queue to look at: approved emails count as queued, opened ones as being sent.
_QUEUED = """SELECT id, prospect_id, mailbox_id, scheduled_at, scheduled_at AS updated_at,
 CASE status WHEN 'approved' THEN 'queued' WHEN 'opened' THEN 'sending' ELSE status END AS status FROM {v_emails}"""


@query("next_queued", "S22 O3", f"""
SELECT id, strftime(scheduled_at, '%Y-%m-%d') AS day FROM ({_QUEUED}) q WHERE status = 'queued' AND mailbox_id NOT IN (2) ORDER BY scheduled_at, id LIMIT 50""")
def next_queued(v):
    return schedule.next_queued(v.sql(_QUEUED), (2,), 50).select("id", F.date_format("scheduled_at", "yyyy-MM-dd").alias("day"))


@query("due_now", "T7", f"SELECT id FROM ({_QUEUED}) q WHERE status = 'queued' AND scheduled_at <= timestamp '1997-01-02 12:00:00'")
def due_now(v):
    import datetime as dt
    return schedule.due_now(v.sql(_QUEUED), dt.datetime(1997, 1, 2, 12)).select("id")


@query("stuck_emails", "F17 T6", f"SELECT id FROM ({_QUEUED}) q WHERE status = 'sending' AND updated_at < timestamp '1997-01-02 11:45:00'")
def stuck_emails(v):
    import datetime as dt
    return schedule.stuck_emails(v.sql(_QUEUED), dt.datetime(1997, 1, 2, 12)).select("id")


@query("recovered_and_unqueued", "F17 M2", f"""
SELECT id, CASE status WHEN 'sending' THEN 'failed' WHEN 'queued' THEN 'approved' ELSE status END AS status FROM ({_QUEUED}) q""")
def recovered_and_unqueued(v):
    return schedule.unqueue(schedule.recover_interrupted(v.sql(_QUEUED))).select("id", "status")


@query("stale_runs", "T6", """
SELECT event_id AS id FROM {events} WHERE event_type = 'view' AND ts < timestamp '2024-01-02 11:58:00'""")
def stale_runs(v):
    runs = v.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "queued").otherwise("running").alias("status"),
                           F.col("ts").alias("created_at"))
    return schedule.stale_runs(runs, NOW).select("id")


@query("send_times_shown", "X32 X33", """
SELECT e.id, strftime(scheduled_at + interval 5 hour, '%Y-%m-%d %H:%M') || ' (Asia/Karachi)' AS shown,
 e.status = 'approved' AND scheduled_at < timestamp '1998-01-01' AS late,
 strftime(date_trunc('day', scheduled_at + interval 5 hour) + interval 4 hour, '%Y-%m-%d %H:%M:%S') AS window_begin,
 strftime(date_trunc('day', scheduled_at + interval 5 hour) + interval 13 hour, '%Y-%m-%d %H:%M:%S') AS window_finish FROM {v_emails} e""")
def send_times_shown(v):
    import datetime as dt
    zone = F.lit("Asia/Karachi")
    begin, finish = schedule.local_day_bounds(schedule.local_date(F.col("scheduled_at"), zone), zone, F.lit("09:00:00"), F.lit("18:00:00"))
    return v.v_emails.select("id", schedule.local_time(F.col("scheduled_at"), zone).alias("shown"),
                             schedule.is_late(dt.datetime(1998, 1, 1)).alias("late"),
                             F.date_format(begin, _FORMAT).alias("window_begin"), F.date_format(finish, _FORMAT).alias("window_finish"))


# Every prospect has one sender, a supplier, so senders grow with the data.
_SENDER = "1 + prospect_id % (SELECT count(*) FROM {supplier})"


def _sender(v):
    return 1 + F.col("prospect_id") % v.supplier.agg(F.count("*")).scalar()


def _senders(v):
    box = (F.col("s_suppkey") + 1).cast("long")
    return v.supplier.select(box.alias("pool"), box.alias("mailbox_id"), F.lit(1).alias("priority"))


@query("schedule_single_mailbox", "W8 A11", """
WITH RECURSIVE q AS MATERIALIZED (SELECT mailbox_id, id, scheduled_at AS earliest, row_number() OVER (PARTITION BY mailbox_id ORDER BY id) AS n
  FROM {v_emails} WHERE status = 'approved'),
f(mailbox_id, n, id, slot, used) AS (
  SELECT DISTINCT mailbox_id, 0::bigint, NULL::bigint, NULL::timestamp, 0 FROM q
  UNION ALL
  SELECT mailbox_id, n, id, CASE WHEN is_full THEN date_trunc('day', c1) + interval 33 hour ELSE c1 END,
    CASE WHEN is_full OR last IS NULL OR date_trunc('day', c1) <> date_trunc('day', last) THEN 1 ELSE used + 1 END
  FROM (SELECT *, last IS NOT NULL AND date_trunc('day', c1) = date_trunc('day', last) AND used >= 3 AS is_full
    FROM (SELECT mailbox_id, n, id, last, used, CASE WHEN c0 < date_trunc('day', c0) + interval 9 hour THEN date_trunc('day', c0) + interval 9 hour
        WHEN c0 >= date_trunc('day', c0) + interval 18 hour THEN date_trunc('day', c0) + interval 33 hour ELSE c0 END AS c1
      FROM (SELECT q.mailbox_id, q.n, q.id, f.slot AS last, f.used, greatest(q.earliest, coalesce(f.slot + interval 600 second, q.earliest)) AS c0
            FROM f JOIN q ON q.mailbox_id = f.mailbox_id AND q.n = f.n + 1))))
SELECT mailbox_id, id AS email_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot FROM f WHERE n > 0""")
def schedule_single_mailbox(v):
    settings = Settings(daily_cap=3, gap_fixed_seconds=600, gap_random_min_seconds=0, gap_random_max_seconds=0)
    requests = v.v_emails.where(F.col("status") == "approved").select(
        F.col("mailbox_id").alias("pool"), F.col("id").alias("arrival"), F.col("id").alias("email_id"),
        F.col("scheduled_at").alias("earliest"), F.lit("UTC").alias("zone"), F.lit(9 * 3600).alias("window_start"),
        F.lit(18 * 3600).alias("window_end"), F.lit(None).cast("long").alias("previous_mailbox_id"),
        schedule.gap_micros(F.col("id"), settings).alias("gap_us"))
    boxes = v.v_mailboxes.select(F.col("id").alias("pool"), F.col("id").alias("mailbox_id"), "priority")
    nobody = v.v_emails.where(F.lit(False)).select("mailbox_id", "scheduled_at")
    return schedule.schedule(requests, boxes, nobody, settings).select(
        "mailbox_id", "email_id", F.date_format("slot", _FORMAT).alias("slot"))


_HELD = ", ".join(f"'{s}'" for s in HOLDS_SLOT if s != "approved")


@query("schedule_pool", "W8 W9", f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT *, {_SENDER} AS box FROM {{v_emails}}),
q AS MATERIALIZED (
  SELECT e.id, e.box, c.send_timezone AS z, 300 + e.id * 7919 % 121 AS gap, row_number() OVER (PARTITION BY e.box ORDER BY e.id) AS n,
    CASE WHEN e.sequence_step = 1 THEN {_NOW} ELSE greatest({_NOW}, l.sent_at + to_days(coalesce(f.days_after_previous, 0))) END AS earliest
  FROM b e JOIN {{v_prospects}} p ON p.id = e.prospect_id JOIN {{v_businesses}} s ON s.id = p.business_id JOIN {{v_campaigns}} c ON c.id = s.discovery_campaign_id
  LEFT JOIN b l ON l.prospect_id = e.prospect_id AND l.sequence_step = e.sequence_step - 1
  LEFT JOIN {{v_follow_ups}} f ON f.sequence_id = p.email_sequence_id AND f.sequence = e.sequence_step - 1
  WHERE e.status = 'approved' AND (e.sequence_step = 1 OR l.sent_at IS NOT NULL)),
h AS (SELECT box, max(scheduled_at) AS last, list(scheduled_at) AS slots FROM b WHERE status IN ({_HELD}) AND scheduled_at IS NOT NULL GROUP BY box),
f(box, n, id, slot, recent) AS (
  SELECT box, 0::bigint, NULL::bigint, last, coalesce(list_filter(slots, lambda x: x > last - interval 26 hour), []) FROM (SELECT DISTINCT box FROM q) d LEFT JOIN h USING (box)
  UNION ALL
  SELECT box, n, id, slot, list_append(list_filter(recent, lambda x: x > slot - interval 26 hour), slot) FROM (
    SELECT box, n, id, recent, CASE WHEN c1 < timezone('UTC', timezone(z, day + interval 18 hour)) AND NOT is_full THEN c1
                                    ELSE timezone('UTC', timezone(z, day + interval 33 hour)) END AS slot FROM (
      SELECT *, greatest(c0, timezone('UTC', timezone(z, day + interval 9 hour))) AS c1,
        coalesce(date_trunc('day', timezone(z, timezone('UTC', last))) = day
          AND len(list_filter(recent, lambda x: date_trunc('day', timezone(z, timezone('UTC', x))) = day)) >= 5, false) AS is_full FROM (
        SELECT *, cast(date_trunc('day', timezone(z, timezone('UTC', c0))) AS timestamp) AS day FROM (
          SELECT q.box, q.n, q.id, q.z, f.slot AS last, f.recent, greatest(q.earliest, coalesce(f.slot + to_seconds(q.gap), q.earliest)) AS c0
          FROM f JOIN q ON q.box = f.box AND q.n = f.n + 1)))))
SELECT id AS email_id, box AS mailbox_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot FROM f WHERE n > 0""")
def schedule_pool(v):
    """Approved emails whose time has come, in the zones of their campaigns, behind what their senders hold already."""
    settings = Settings(daily_cap=5)
    # asked for what is approved, what was sent before and what is held: computed once, kept in reliable storage
    emails = materialize(v.v_emails.select("id", "prospect_id", "sequence_step", "status", "sent_at", "scheduled_at", "mailbox_id"))
    due = schedule.earliest_send(emails, v.v_prospects, v.v_follow_ups, NOW, emails.where(F.col("status") == "approved")).where(F.col("problem").isNull())
    campaign = v.v_campaigns.select(F.col("id").alias("discovery_campaign_id"), "send_timezone")
    zone = v.v_businesses.select(F.col("id").alias("business_id"), "discovery_campaign_id").join(campaign, "discovery_campaign_id")
    business = v.v_prospects.select(F.col("id").alias("prospect_id"), "business_id")
    gap = ((300 + F.col("id") * 7919 % 121) * 1_000_000).cast("long")
    requests = due.join(business, "prospect_id").join(zone, "business_id").select(
        _sender(v).alias("pool"), F.col("id").alias("arrival"), F.col("id").alias("email_id"), "earliest", F.col("send_timezone").alias("zone"),
        F.lit(9 * 3600).alias("window_start"), F.lit(18 * 3600).alias("window_end"), "previous_mailbox_id", gap.alias("gap_us"))
    held = emails.where(F.col("status").isin(*[s for s in HOLDS_SLOT if s != "approved"])).select(_sender(v).alias("mailbox_id"), "scheduled_at")
    return schedule.schedule(requests, _senders(v), held, settings).select(
        "email_id", "mailbox_id", F.date_format("slot", _FORMAT).alias("slot"))
