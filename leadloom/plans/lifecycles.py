"""Follow-up, stage and review queries."""

from pyspark.sql import functions as F

from leadloom.operators import lifecycle
from leadloom.plans.registry import query
from leadloom.plans.reporting import LATEST, NOW

_NOW = "timestamp '2024-01-02 12:00:00'"


@query("follow_ups_due", "J11 W4", f"""
SELECT p.id AS prospect_id, l.sequence_step + 1 AS step, l.sequence_step AS sequence, l.id AS previous_email_id, f.template_id AS step_template_id
FROM {{v_prospects}} p JOIN ({LATEST}) l ON l.prospect_id = p.id
JOIN {{v_follow_ups}} f ON f.sequence_id = p.email_sequence_id AND f.sequence = l.sequence_step AND f.template_id IS NOT NULL
WHERE NOT p.do_not_contact AND p.sequence_stopped_at IS NULL AND NOT any_replied AND l.status IN ('sent', 'opened') AND l.sent_at IS NOT NULL""")
def follow_ups_due(v):
    return lifecycle.follow_ups_due(v.v_prospects, v.v_emails, v.v_follow_ups)


@query("latest_email", "W4 A11", f"""
SELECT prospect_id, id, sequence_step, status, strftime(last_sent, '%Y-%m-%d') AS last_sent FROM ({LATEST}) l""")
def latest_email(v):
    return lifecycle.latest_email(v.v_emails).select(
        "prospect_id", "latest.id", "latest.sequence_step", "latest.status", F.date_format("last_sent", "yyyy-MM-dd").alias("last_sent"))


@query("previous_step", "J8", """
SELECT e.id, b.id AS previous_id, b.status AS previous_status, b.subject AS previous_subject FROM {v_emails} e
LEFT JOIN {v_emails} b ON b.prospect_id = e.prospect_id AND b.sequence_step = e.sequence_step - 1""")
def previous_step(v):
    return lifecycle.previous_step(v.v_emails).select("id", "previous_id", "previous_status", "previous_subject")


@query("quota_exhausted", "T5", f"""
SELECT p.id AS prospect_id, p.pipeline_stage, strftime(last_sent, '%Y-%m-%d') AS last_sent FROM {{v_prospects}} p JOIN ({LATEST}) l ON l.prospect_id = p.id
LEFT JOIN {{v_follow_ups}} f ON f.sequence_id = p.email_sequence_id AND f.sequence = l.sequence_step AND f.template_id IS NOT NULL
WHERE p.pipeline_stage IN ('initial_email', 'follow_up') AND l.last_sent < {_NOW} - interval 3 day AND l.status IN ('sent', 'opened')
 AND (p.sequence_stopped_at IS NOT NULL OR p.do_not_contact OR f.sequence IS NULL)""")
def quota_exhausted(v):
    return lifecycle.quota_exhausted(v.v_prospects, v.v_emails, v.v_follow_ups, NOW).withColumn(
        "last_sent", F.date_format("last_sent", "yyyy-MM-dd"))


@query("expired_waits", "T5", f"""
SELECT p.id AS prospect_id, p.pipeline_stage, strftime(last_sent + interval 3 day, '%Y-%m-%d') AS expired FROM {{v_prospects}} p JOIN ({LATEST}) l ON l.prospect_id = p.id
LEFT JOIN {{v_follow_ups}} f ON f.sequence_id = p.email_sequence_id AND f.sequence = l.sequence_step AND f.template_id IS NOT NULL
WHERE p.pipeline_stage IN ('initial_email', 'follow_up') AND l.last_sent < {_NOW} - interval 3 day AND l.status IN ('sent', 'opened')
 AND (p.sequence_stopped_at IS NOT NULL OR p.do_not_contact OR f.sequence IS NULL)""")
def expired_waits(v):
    """What the stream of waits that ran out leads to, its waits taken from the table."""
    last = lifecycle.latest_email(v.v_emails).where(F.col("last_sent") < F.lit(NOW) - F.expr("INTERVAL 3 DAYS"))
    waits = last.select("prospect_id", (F.col("last_sent") + F.expr("INTERVAL 3 DAYS")).alias("expired_at"))
    return lifecycle.without_next_step(waits, v.v_prospects, v.v_emails, v.v_follow_ups).select(
        "prospect_id", "pipeline_stage", F.date_format("expired_at", "yyyy-MM-dd").alias("expired"))


@query("infer_stage", "M11", """
SELECT p.id AS prospect_id, CASE WHEN bool_or(e.status = 'replied') OR starts_with(lower(coalesce(any_value(p.sequence_stop_reason), '')), 'repl') THEN 'replied'
 WHEN any_value(p.sequence_stopped_at) IS NOT NULL THEN 'lost' WHEN bool_or(e.status IN ('sent', 'opened') AND e.sequence_step > 1) THEN 'follow_up'
 WHEN bool_or(e.status IN ('sent', 'opened')) THEN 'initial_email' WHEN bool_or(e.status = 'approved') THEN 'ready_to_send' END AS inferred_stage
FROM {v_prospects} p JOIN {v_emails} e ON e.prospect_id = p.id GROUP BY p.id""")
def infer_stage(v):
    return lifecycle.infer_stage(v.v_prospects, v.v_emails)


# Commands derived from events: several per email, in event order.
_COMMANDS = """SELECT e.event_id AS position, m.id AS email_id,
 CASE e.event_type WHEN 'view' THEN 'approve' WHEN 'click' THEN 'reject' WHEN 'signup' THEN 'reopen' WHEN 'purchase' THEN 'edit' ELSE 'approve' END AS action,
 e.event_id % 7 = 0 AS new_placeholder
FROM {events} AS e JOIN {v_emails} AS m ON m.prospect_id = e.user_id AND m.sequence_step = 1"""


@query("transition_emails", "M1 F18", f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT k.*, m.status AS initial, contains(m.subject, 'PLACEHOLDER') AS placeholder,
   (p.email_status = 'deliverable' OR p.approved_by_person) AND p.outreach_status = 'ready' AND NOT p.do_not_contact AND p.sequence_stopped_at IS NULL AS cleared,
   row_number() OVER (PARTITION BY k.email_id ORDER BY k.position) AS n
  FROM ({_COMMANDS}) k JOIN {{v_emails}} m ON m.id = k.email_id JOIN {{v_prospects}} p ON p.id = m.prospect_id),
start AS (SELECT email_id, any_value(initial) AS state, any_value(placeholder) AS ph FROM c GROUP BY 1),
f(email_id, n, position, action, before, reason, state, ph) AS (
  SELECT email_id, 0::bigint, NULL::bigint, NULL::varchar, NULL::varchar, NULL::varchar, state, ph FROM start
  UNION ALL
  SELECT s.email_id, s.n, s.position, s.action, s.before, s.reason,
    CASE WHEN s.reason IS NOT NULL THEN s.before WHEN s.action = 'approve' THEN 'approved' WHEN s.action = 'reject' THEN 'rejected' ELSE 'in_review' END,
    CASE WHEN s.reason IS NULL AND s.action = 'edit' THEN s.new_placeholder ELSE s.ph END
  FROM (SELECT c.email_id, c.n, c.position, c.action, f.state AS before, c.new_placeholder, f.ph,
    CASE c.action WHEN 'approve' THEN CASE WHEN f.ph THEN 'placeholder text left' WHEN NOT c.cleared THEN 'prospect can no longer be emailed'
        WHEN f.state <> 'in_review' THEN 'not in review' END
      WHEN 'reject' THEN CASE WHEN f.state NOT IN ('in_review', 'approved', 'queued', 'failed') THEN 'cannot be rejected' END
      WHEN 'reopen' THEN CASE WHEN f.state NOT IN ('rejected', 'approved', 'queued', 'failed') THEN 'cannot be reopened' END
      ELSE CASE WHEN f.state NOT IN ('in_review', 'approved', 'queued', 'rejected', 'failed') THEN 'cannot be edited' END END AS reason
   FROM f JOIN c ON c.email_id = f.email_id AND c.n = f.n + 1) s)
SELECT position, email_id, action, before, reason IS NULL AS ok, reason, state AS after FROM f WHERE n > 0""")
def transition_emails(v):
    return lifecycle.transition_emails(v.v_emails, v.v_prospects, v.sql(_COMMANDS))


_MOVES = """SELECT event_id AS position, user_id AS prospect_id,
 CASE event_id % 7 WHEN 0 THEN 'replied' WHEN 1 THEN 'follow_up' WHEN 2 THEN 'won' WHEN 3 THEN 'initial_email' WHEN 4 THEN 'lost' WHEN 5 THEN 'new_lead' ELSE 'follow_up' END AS stage
FROM {events}"""


@query("move_stage", "M4", f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT m.*, coalesce(p.pipeline_stage, 'new_lead') AS initial, p.sequence_stopped_at IS NOT NULL AS stopped_first, p.do_not_contact AS dnc,
   row_number() OVER (PARTITION BY m.prospect_id ORDER BY m.position) AS n FROM ({_MOVES}) m JOIN {{v_prospects}} p ON p.id = m.prospect_id),
start AS (SELECT prospect_id, any_value(initial) AS stage, any_value(stopped_first) AS stopped FROM c GROUP BY 1),
f(prospect_id, n, position, from_stage, to_stage, outcome, stage, stopped) AS (
  SELECT prospect_id, 0::bigint, NULL::bigint, NULL::varchar, NULL::varchar, NULL::varchar, stage, stopped FROM start
  UNION ALL
  SELECT s.prospect_id, s.n, s.position, s.cur, s.stage, s.outcome,
    CASE WHEN starts_with(s.outcome, 'moved') THEN s.stage ELSE s.cur END,
    CASE s.outcome WHEN 'moved and stopped' THEN true WHEN 'moved and resumed' THEN false ELSE s.was END
  FROM (SELECT c.prospect_id, c.n, c.position, c.stage, f.stage AS cur, f.stopped AS was,
     CASE WHEN c.stage = f.stage THEN 'already there' WHEN c.stage IN ('replied', 'demo_booked', 'demo_done', 'won', 'lost', 'quota_exhausted') THEN 'moved and stopped'
       WHEN c.stage IN ('initial_email', 'follow_up') AND f.stopped THEN CASE WHEN c.dnc THEN 'refused: do-not-contact' ELSE 'moved and resumed' END
       ELSE 'moved' END AS outcome
   FROM f JOIN c ON c.prospect_id = f.prospect_id AND c.n = f.n + 1) s)
SELECT position, prospect_id, from_stage, to_stage, outcome FROM f WHERE n > 0""")
def move_stage(v):
    return lifecycle.move_stage(v.v_prospects, v.sql(_MOVES))


@query("advance_stage", "M3", """
WITH s AS (SELECT prospect_id, max(CASE WHEN sequence_step = 1 THEN 3 ELSE 4 END) AS target FROM {v_emails} WHERE sent_at IS NOT NULL GROUP BY 1)
SELECT p.id AS prospect_id, p.pipeline_stage AS from_stage, CASE target WHEN 3 THEN 'initial_email' ELSE 'follow_up' END AS to_stage
FROM {v_prospects} p JOIN s ON s.prospect_id = p.id
WHERE CASE coalesce(p.pipeline_stage, 'new_lead') WHEN 'new_lead' THEN 1 WHEN 'ready_to_send' THEN 2 WHEN 'initial_email' THEN 3 WHEN 'follow_up' THEN 4 ELSE 99 END < target""")
def advance_stage(v):
    signals = v.v_emails.where(F.col("sent_at").isNotNull()).select(
        "prospect_id", F.when(F.col("sequence_step") == 1, "initial_email").otherwise("follow_up").alias("stage"))
    return lifecycle.advance_stage(v.v_prospects, signals)


_STOPS = "SELECT event_id AS position, user_id AS prospect_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS reason FROM {events} WHERE event_type = 'purchase'"


@query("stop_emails", "M5", f"""
WITH s AS (SELECT prospect_id, coalesce(nullif(arg_min(reason, position), ''), 'stopped') AS reason FROM ({_STOPS}) x GROUP BY 1)
SELECT e.id, CASE WHEN s.reason IS NOT NULL AND e.status IN ('in_review', 'approved', 'queued', 'failed') THEN 'rejected' ELSE e.status END AS status,
 CASE WHEN s.reason IS NOT NULL AND e.status IN ('in_review', 'approved', 'queued', 'failed') THEN 'Sequence stopped (' || s.reason || ').' END AS review_note,
 CASE WHEN s.reason IS NOT NULL AND e.status IN ('in_review', 'approved', 'queued', 'failed') THEN NULL ELSE strftime(scheduled_at, '%Y-%m-%d') END AS scheduled
FROM {{v_emails}} e LEFT JOIN s ON s.prospect_id = e.prospect_id""")
def stop_emails(v):
    _, mail = lifecycle.stop_prospects(v.v_prospects, v.v_emails, v.sql(_STOPS), NOW)
    return mail.select("id", "status", "review_note", F.date_format("scheduled_at", "yyyy-MM-dd").alias("scheduled"))


@query("stop_people", "M5", f"""
WITH s AS (SELECT prospect_id, coalesce(nullif(arg_min(reason, position), ''), 'stopped') AS reason FROM ({_STOPS}) x GROUP BY 1)
SELECT p.id, strftime(coalesce(p.sequence_stopped_at, CASE WHEN s.reason IS NOT NULL THEN {_NOW} END), '%Y-%m-%d') AS stopped,
 CASE WHEN p.sequence_stopped_at IS NULL THEN coalesce(s.reason, p.sequence_stop_reason) ELSE p.sequence_stop_reason END AS sequence_stop_reason
FROM {{v_prospects}} p LEFT JOIN s ON s.prospect_id = p.id""")
def stop_people(v):
    people, _ = lifecycle.stop_prospects(v.v_prospects, v.v_emails, v.sql(_STOPS), NOW)
    return people.select("id", F.date_format("sequence_stopped_at", "yyyy-MM-dd").alias("stopped"), "sequence_stop_reason")


_MAIL_AFTER_STOP = """SELECT e.*, CASE WHEN id % 3 = 0 THEN 'Sequence stopped (lost).' WHEN id % 3 = 1 THEN 'bad text' END AS review_note,
 CASE WHEN status = 'in_review' THEN 'rejected' ELSE status END AS now_status FROM {v_emails} AS e"""


@query("resume_emails", "M6", f"""
WITH m AS ({_MAIL_AFTER_STOP}), r AS (SELECT id FROM {{v_prospects}} WHERE sequence_stopped_at IS NOT NULL AND NOT do_not_contact)
SELECT m.id, CASE WHEN r.id IS NULL THEN m.now_status WHEN m.now_status = 'replied' THEN 'sent'
  WHEN m.now_status = 'rejected' AND starts_with(coalesce(m.review_note, ''), 'Sequence stopped (') THEN 'in_review' ELSE m.now_status END AS status,
 CASE WHEN r.id IS NOT NULL AND m.now_status = 'rejected' AND starts_with(coalesce(m.review_note, ''), 'Sequence stopped (') THEN NULL ELSE m.review_note END AS review_note
FROM m LEFT JOIN r ON r.id = m.prospect_id""")
def resume_emails(v):
    mail = v.sql(_MAIL_AFTER_STOP).drop("status").withColumnRenamed("now_status", "status")
    asked = v.orders.select(F.col("o_orderkey").alias("prospect_id"))
    return lifecycle.resume_prospects(v.v_prospects, mail, asked)[1].select("id", "status", "review_note")


@query("resume_refused", "M6", """
SELECT id AS prospect_id, 'do-not-contact; clear that first' AS reason FROM {v_prospects} WHERE sequence_stopped_at IS NOT NULL AND do_not_contact""")
def resume_refused(v):
    asked = v.orders.select(F.col("o_orderkey").alias("prospect_id"))
    return lifecycle.resume_prospects(v.v_prospects, v.v_emails.withColumn("review_note", F.lit(None).cast("string")), asked)[2]


@query("record_sent", "M7", """
SELECT e.id AS email_id, p.id AS prospect_id, 'sent' AS status, 'contacted' AS outreach_status,
 CASE WHEN coalesce(p.pipeline_stage, 'new_lead') IN ('new_lead', 'ready_to_send') THEN CASE WHEN e.sequence_step = 1 THEN 'initial_email' ELSE 'follow_up' END
  WHEN p.pipeline_stage = 'initial_email' AND e.sequence_step > 1 THEN 'follow_up' ELSE p.pipeline_stage END AS pipeline_stage,
 CASE WHEN p.sequence_stopped_at IS NULL AND NOT p.do_not_contact AND f.template_id IS NOT NULL THEN 'follow-up ' || e.sequence_step ELSE 'sequence finished' END AS next
FROM {v_emails} e JOIN {v_prospects} p ON p.id = e.prospect_id
LEFT JOIN {v_follow_ups} f ON f.sequence_id = p.email_sequence_id AND f.sequence = e.sequence_step WHERE e.status = 'approved'""")
def record_sent(v):
    sends = v.v_emails.where(F.col("status") == "approved").select(F.col("id").alias("email_id"), F.col("scheduled_at").alias("sent_at"))
    return lifecycle.record_sent(v.v_prospects, v.v_emails, v.v_follow_ups, sends).drop("new_sent_at")


@query("mark_business_replied", "M8", """
SELECT business_id, id AS email_id, prospect_id FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY sent_at DESC, id DESC) AS rn
 FROM {v_emails_of} WHERE status IN ('sent', 'opened')) x WHERE rn = 1""")
def mark_business_replied(v):
    return lifecycle.mark_business_replied(v.v_emails_of, v.v_businesses.select(F.col("id").alias("business_id")))


_REVIEWS = """SELECT l_orderkey AS prospect_id, l_linenumber AS position, CASE WHEN (l_orderkey + 2 * l_linenumber) % 3 = 0 THEN 'reject' ELSE 'approve' END AS action FROM {lineitem}"""


@query("review_prospects", "M9 U6", f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY position) AS n FROM ({_REVIEWS}) r),
f(prospect_id, n, action, done, outreach_status, approved_by_person, email_status) AS (
  SELECT id, 0::bigint, NULL::varchar, NULL::boolean, outreach_status, approved_by_person, email_status FROM {{v_prospects}}
  UNION ALL
  SELECT prospect_id, n, action, ok, CASE WHEN ok THEN CASE action WHEN 'approve' THEN 'ready' ELSE 'rejected' END ELSE outreach_status END,
    CASE WHEN ok THEN action = 'approve' ELSE approved_by_person END, email_status
  FROM (SELECT f.prospect_id, c.n, c.action, f.outreach_status, f.approved_by_person, f.email_status, CASE c.action WHEN 'approve'
      THEN f.outreach_status IN ('needs_review', 'pending', 'rejected') AND coalesce(f.email_status, '') <> 'undeliverable' ELSE f.outreach_status <> 'contacted' END AS ok
    FROM f JOIN c ON c.prospect_id = f.prospect_id AND c.n = f.n + 1) x),
l AS (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY n DESC) AS last FROM f)
SELECT l.prospect_id, l.action, outreach_status, approved_by_person FROM l WHERE last = 1 AND n > 0""")
def review_prospects(v):
    return lifecycle.review_prospects(v.v_prospects, v.sql(_REVIEWS)).drop("done")


@query("mark_do_not_contact", "M9", """
SELECT p.id, p.do_not_contact OR coalesce(b.review_status, '') = 'rejected' AS do_not_contact FROM {v_prospects} p JOIN {v_businesses} b ON b.id = p.business_id""")
def mark_do_not_contact(v):
    rejected = v.v_businesses.where(F.col("review_status") == "rejected").select(F.col("id").alias("business_id"))
    ids = v.v_prospects.join(rejected, "business_id", "left_semi").select(F.col("id").alias("prospect_id"))
    return lifecycle.set_do_not_contact(v.v_prospects, ids).select("id", "do_not_contact")
