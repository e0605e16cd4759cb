"""Dashboard queries."""

import datetime as dt

from pyspark.sql import functions as F

from leadloom.operators import lifecycle, qualify, reports
from leadloom.operators.outreach import ready_prospects
from leadloom.plans.registry import query
from leadloom.sources.report import usage_log
from leadloom.schemas import EMAIL_STATUSES, PIPELINE_STAGES

NOW = dt.datetime(2024, 1, 2, 12, 0, 0)
_STATUS_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(EMAIL_STATUSES))
_STAGE_VALUES = ", ".join(f"({i}, '{s}')" for i, (s, _) in enumerate(PIPELINE_STAGES))

# DuckDB texts shared by several oracles
JOINED = """SELECT b.*, w.business_id IS NOT NULL AS has_profile, w.status AS profile_status, w.qualification_score,
  w.contact_discovery_status, w.updated_at AS profile_updated_at, c.min_score, c.prompt AS campaign_prompt
FROM {v_businesses} b JOIN {v_campaigns} c ON c.id = b.discovery_campaign_id
LEFT JOIN {v_website_profiles} w ON w.business_id = b.id"""
QUALIFIED = """((profile_status = 'completed' AND qualification_score >= min_score
  AND coalesce(review_status, '') <> 'rejected') OR coalesce(review_status, '') = 'approved')"""
NEEDS_REVIEW = """(review_status IS NULL AND (
  (profile_status = 'completed' AND qualification_score < min_score) OR profile_status = 'failed'
  OR (coalesce(website_url, '') = '' AND (NOT has_profile OR profile_status IN ('pending', 'failed')))))"""
IS_READY = """((email_status = 'deliverable' OR approved_by_person) AND outreach_status = 'ready'
  AND NOT do_not_contact AND sequence_stopped_at IS NULL)"""
READY = f"""SELECT p.* FROM {{v_prospects}} p WHERE {IS_READY}
 AND NOT EXISTS (SELECT 1 FROM {{v_emails_of}} e WHERE e.contact_id = p.contact_id AND e.prospect_id <> p.id)
 AND NOT EXISTS (SELECT 1 FROM {{v_prospects}} o WHERE o.contact_id = p.contact_id AND o.id <> p.id AND o.do_not_contact)
 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM {{v_prospects}} WHERE {IS_READY}) o WHERE o.contact_id = p.contact_id AND o.id < p.id)
 AND NOT EXISTS (SELECT 1 FROM {{v_prospects}} o WHERE lower(o.email) = lower(p.email) AND o.id <> p.id AND o.do_not_contact)
 AND NOT EXISTS (SELECT 1 FROM {{v_prospects}} o WHERE lower(o.email) = lower(p.email) AND o.id <> p.id
                 AND (o.pipeline_stage IS NOT NULL OR o.id IN (SELECT prospect_id FROM {{v_emails}})))
 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM {{v_prospects}} WHERE {IS_READY}) o
                 WHERE lower(o.email) = lower(p.email) AND o.id < p.id)"""
LATEST = """SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY prospect_id ORDER BY sequence_step DESC) AS rn,
  max(sent_at) OVER (PARTITION BY prospect_id) AS last_sent,
  bool_or(status = 'replied') OVER (PARTITION BY prospect_id) AS any_replied FROM {v_emails} e) x WHERE rn = 1"""
LEADS = f"""SELECT *, coalesce(pipeline_stage, 'new_lead') AS stage FROM {{v_prospects}}
WHERE pipeline_stage IS NOT NULL OR id IN (SELECT id FROM ({READY}) r)"""
CHILDREN = """SELECT b.id AS business_id,
  (SELECT count(*) FROM {v_contacts} c WHERE c.business_id = b.id) AS contact_total,
  (SELECT count(*) FROM {v_prospects} p WHERE p.business_id = b.id) AS prospect_total,
  (SELECT count(*) FROM {v_prospects} p WHERE p.business_id = b.id AND outreach_status = 'ready' AND NOT do_not_contact) > 0 AS has_ready,
  (SELECT count(*) FROM {v_prospects} p WHERE p.business_id = b.id AND outreach_status = 'needs_review') > 0 AS has_prospect_review,
  (SELECT count(*) FROM {v_emails_of} e WHERE e.business_id = b.id) AS email_total,
  (SELECT count(*) FROM {v_emails_of} e WHERE e.business_id = b.id AND status = 'in_review') > 0 AS email_in_review,
  (SELECT count(*) FROM {v_emails_of} e WHERE e.business_id = b.id AND status = 'approved') > 0 AS email_approved,
  (SELECT count(*) FROM {v_emails_of} e WHERE e.business_id = b.id AND status = 'replied') > 0 AS email_replied,
  (SELECT count(*) FROM {v_emails_of} e WHERE e.business_id = b.id AND status IN ('sent', 'opened')) > 0 AS email_sent
FROM {v_businesses} b"""


def joined(v):
    return qualify.with_profile(v.v_businesses, v.v_website_profiles, v.v_campaigns)


def full(v):
    return qualify.with_children(joined(v), qualify.children(v.v_contacts, v.v_prospects, v.v_emails_of))


@query("sequence_results", "A6 J5", """
SELECT CASE WHEN e.sequence_step = 1 THEN 'First email' ELSE 'Follow-up ' || (e.sequence_step - 1) END AS step,
       coalesce(s.name, '-') AS variation, count(*) AS sent, count(*) FILTER (e.status = 'replied') AS replied,
       cast(round_even(100 * count(*) FILTER (e.status = 'replied') / count(*), 0) AS int) AS reply_rate
FROM {v_emails} e JOIN {v_prospects} p ON p.id = e.prospect_id LEFT JOIN {v_sequences} s ON s.id = p.email_sequence_id
WHERE e.sent_at IS NOT NULL GROUP BY 1, 2""")
def sequence_results(v):
    return reports.sequence_results(v.v_emails, v.v_prospects, v.v_sequences)


@query("email_status_counts", "A1", f"""
SELECT position, s.status, count(e.id) AS n FROM (VALUES {_STATUS_VALUES}) s(position, status)
LEFT JOIN {{v_emails}} e ON e.status = s.status GROUP BY 1, 2""")
def email_status_counts(v):
    return reports.status_counts(v.v_emails)


@query("open_rate", "A2", """
SELECT count(*) FILTER (status = 'opened') AS opened, count(*) FILTER (status IN ('sent', 'opened')) AS sent,
 cast(round_even(100 * count(*) FILTER (status = 'opened') / count(*) FILTER (status IN ('sent', 'opened')), 0) AS int) AS open_rate
FROM {v_emails}""")
def open_rate(v):
    return reports.open_rate(v.v_emails)


@query("pipeline_stats", "A3", f"""
SELECT 'campaigns' AS metric, status AS key, count(*) AS n FROM {{v_campaigns}} GROUP BY 2
UNION ALL SELECT 'businesses', 'total', count(*) FROM {{v_businesses}}
UNION ALL SELECT 'website_research', status, count(*) FROM {{v_website_profiles}} GROUP BY 2
UNION ALL SELECT 'contact_discovery', contact_discovery_status, count(*) FROM {{v_website_profiles}}
  WHERE contact_discovery_status IS NOT NULL GROUP BY 2
UNION ALL SELECT 'contacts', 'total', count(*) FROM {{v_contacts}}
UNION ALL SELECT 'prospects', outreach_status, count(*) FROM {{v_prospects}} GROUP BY 2
UNION ALL SELECT 'emails', s.status, count(e.id) FROM (VALUES {_STATUS_VALUES}) s(position, status)
  LEFT JOIN {{v_emails}} e ON e.status = s.status GROUP BY 2""")
def pipeline_stats(v):
    return reports.pipeline_stats(v.v_campaigns, v.v_businesses, v.v_website_profiles, v.v_contacts, v.v_prospects,
                                  v.v_emails)


_USAGE_SUMS = """cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens,
 cast(sum(reasoning_tokens) AS bigint) AS reasoning_tokens, cast(sum(credits) AS decimal(18, 2)) AS credits, count(*) AS calls"""


@query("usage_summary", "A4 S11", f"""
SELECT action, provider, model, grouping(action) = 1 AS is_total, {_USAGE_SUMS}
FROM {{v_usage}} GROUP BY GROUPING SETS ((), (action, provider, model))""")
def usage_summary(v):
    return reports.usage_summary(usage_log(v.v_usage.withColumn("detail", F.lit(None).cast("string"))))


@query("usage_by_day_range", "F21 A4", f"""
SELECT action, provider, model, grouping(action) = 1 AS is_total, {_USAGE_SUMS}
FROM {{v_usage}} WHERE created_at >= timestamp '2024-01-02 19:00:00' AND created_at < timestamp '2024-01-09 19:00:00'
GROUP BY GROUPING SETS ((), (action, provider, model))""")
def usage_by_day_range(v):
    return reports.usage_summary(reports.day_range(v.v_usage, "created_at", "2024-01-03", "2024-01-09", "Asia/Karachi"))


@query("usage_credits", "A18", """
SELECT id, cast(CASE WHEN action = 'decision_makers' THEN ceil(business_id / 10) WHEN action = 'verification'
  THEN CASE WHEN business_id % 4 <> 0 THEN 0.5 ELSE 0 END ELSE 0 END AS decimal(8, 2)) AS credits FROM {v_usage}""")
def usage_credits(v):
    credits = reports.usage_credits(F.col("action"), F.col("business_id"), F.col("business_id") % 4 != 0)
    return v.v_usage.select("id", credits.cast("decimal(8,2)").alias("credits"))


@query("funnel", "A5", f"""
WITH j AS ({JOINED}), ready AS ({READY})
SELECT * FROM (
SELECT 0 AS position, 'Businesses found' AS label, count(*) AS n FROM {{v_businesses}}
UNION ALL SELECT 1, 'Websites researched', count(*) FROM {{v_website_profiles}} WHERE status = 'completed'
UNION ALL SELECT 2, 'Qualified', count(*) FROM j WHERE {QUALIFIED}
UNION ALL SELECT 3, 'Contacts found', count(*) FROM {{v_contacts}}
UNION ALL SELECT 4, 'Ready to email', count(*) FROM ready
UNION ALL SELECT 5, 'Emails in review', count(*) FROM {{v_emails}} WHERE status = 'in_review'
UNION ALL SELECT 6, 'Approved', count(*) FROM {{v_emails}} WHERE status = 'approved'
UNION ALL SELECT 7, 'Queued', count(*) FROM {{v_emails}} WHERE status IN ('queued', 'sending')
UNION ALL SELECT 8, 'Sent', count(*) FROM {{v_emails}} WHERE status IN ('sent', 'opened')) f""")
def funnel(v):
    business = joined(v).agg(F.count("*").alias("found"), F.count_if(F.col("profile_status") == "completed").alias("researched"),
                             F.count_if(qualify.is_qualified()).alias("qualified"))
    mail = v.v_emails.agg(*[F.count_if(F.col("status").isin(*s)).alias(n) for n, s in (
        ("in_review", ["in_review"]), ("approved", ["approved"]), ("queued", ["queued", "sending"]), ("sent", ["sent", "opened"]))])
    count = F.count("*").alias("n")
    return reports.stacked([
        (business, {0: ("Businesses found", "found"), 1: ("Websites researched", "researched"), 2: ("Qualified", "qualified")}),
        (v.v_contacts.agg(count), {3: ("Contacts found", "n")}),
        (ready_prospects(v.v_prospects, v.v_emails).agg(count), {4: ("Ready to email", "n")}),
        (mail, {5: ("Emails in review", "in_review"), 6: ("Approved", "approved"), 7: ("Queued", "queued"), 8: ("Sent", "sent")})])


@query("stage_counts", "A7 J20", f"""
WITH l AS ({LEADS}) SELECT position, s.stage, count(l.id) AS n FROM (VALUES {_STAGE_VALUES}) s(position, stage)
LEFT JOIN l ON l.stage = s.stage GROUP BY 1, 2""")
def stage_counts(v):
    return reports.stage_counts(lifecycle.leads(v.v_prospects, v.v_emails))


@query("leads", "J20", f"SELECT id, stage FROM ({LEADS}) l")
def leads(v):
    return lifecycle.leads(v.v_prospects, v.v_emails).select("id", "stage")


@query("board_top_k", "W10 O4", f"""
WITH l AS ({LEADS}) SELECT id, stage, rank, total, greatest(total - 200, 0) AS more FROM (
 SELECT id, stage, row_number() OVER (PARTITION BY stage ORDER BY stage_changed_at DESC NULLS FIRST, id DESC) AS rank,
        count(*) OVER (PARTITION BY stage) AS total FROM l) x WHERE rank <= 200""")
def board_top_k(v):
    return reports.board(lifecycle.leads(v.v_prospects, v.v_emails)).drop("stage_changed_at")


_CHANGES = """SELECT event_id AS id, user_id AS prospect_id, ts AS changed_at,
 CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'new_lead' WHEN 'signup' THEN 'initial_email' ELSE 'follow_up' END AS from_stage,
 CASE event_type WHEN 'view' THEN 'ready_to_send' WHEN 'click' THEN 'initial_email' WHEN 'signup' THEN 'follow_up' ELSE 'won' END AS to_stage
FROM {events}"""


@query("stage_history", "W14", f"""
SELECT prospect_id, rank, CASE coalesce(from_stage, 'new_lead') WHEN 'new_lead' THEN 'New Lead' WHEN 'initial_email' THEN 'Initial Email'
 ELSE 'Follow-up' END AS from_label, CASE to_stage WHEN 'ready_to_send' THEN 'Ready to Send' WHEN 'initial_email' THEN 'Initial Email'
 WHEN 'follow_up' THEN 'Follow-up' ELSE 'Won' END AS to_label, strftime(changed_at, '%Y-%m-%d %H:%M') AS changed
FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY changed_at DESC, id DESC) AS rank FROM ({_CHANGES}) c) x
WHERE rank <= 20""")
def stage_history(v):
    return reports.stage_history(v.sql(_CHANGES)).withColumn(
        "changed", F.date_format("changed_at", "yyyy-MM-dd HH:mm")).drop("changed_at")


@query("next_in_review", "W13", """
WITH r AS (SELECT id FROM {v_emails} WHERE status = 'in_review')
SELECT id, coalesce(lead(id) OVER (ORDER BY id), nullif((SELECT min(id) FROM r), id)) AS next_id FROM r""")
def next_in_review(v):
    return reports.next_in_review(v.v_emails)


@query("distinct_children", "A8", """
SELECT b.id, (SELECT count(*) FROM {v_contacts} c WHERE c.business_id = b.id) AS contact_total,
 (SELECT count(*) FROM {v_prospects} p WHERE p.business_id = b.id) AS prospect_total FROM {v_businesses} b""")
def distinct_children(v):
    return full(v).select("id", "contact_total", "prospect_total")


@query("quick_filter_counts", "A9 F19", f"""
WITH j AS ({JOINED}), k AS ({CHILDREN}), f AS (SELECT * FROM j JOIN k ON k.business_id = j.id)
SELECT * FROM (
SELECT 0 AS position, 'All businesses' AS label, count(*) AS n FROM f
UNION ALL SELECT 1, 'Not researched', count(*) FROM f WHERE NOT has_profile OR profile_status = 'pending'
UNION ALL SELECT 2, 'Needs your review', count(*) FROM f WHERE {NEEDS_REVIEW}
UNION ALL SELECT 3, 'Qualified', count(*) FROM f WHERE {QUALIFIED}
UNION ALL SELECT 4, 'Score 80+', count(*) FROM f WHERE qualification_score >= 80
UNION ALL SELECT 5, '100+ reviews', count(*) FROM f WHERE google_review_count >= 100
UNION ALL SELECT 6, 'Rated 4.5+', count(*) FROM f WHERE google_rating >= 4.5
UNION ALL SELECT 7, 'No contacts yet', count(*) FROM f WHERE contact_total = 0
UNION ALL SELECT 8, 'Ready to email', count(*) FROM f WHERE has_ready
UNION ALL SELECT 9, 'Email sent', count(*) FROM f WHERE email_sent) q""")
def quick_filter_counts(v):
    return qualify.quick_filter_counts(full(v))


@query("duplicate_keys", "A10", """
WITH d AS (SELECT name, count(*) AS n FROM (SELECT lower(name) AS name FROM {v_listings}) x GROUP BY 1 HAVING count(*) > 1
           ORDER BY name LIMIT 20)
SELECT d.name, l.arrival AS id, d.n FROM {v_listings} l JOIN d ON d.name = lower(l.name)""")
def duplicate_keys(v):
    listings = v.v_listings.select(F.col("arrival").alias("id"), F.lower("name").alias("name"))
    return reports.duplicate_keys(listings, "name")


@query("latest_slots", "A11", """
SELECT mailbox_id, strftime(max(scheduled_at), '%Y-%m-%d') AS latest FROM {v_emails}
WHERE status IN ('approved', 'queued', 'sending', 'sent', 'opened', 'replied') GROUP BY 1""")
def latest_slots(v):
    from leadloom.schemas import HOLDS_SLOT
    return reports.latest_slots(v.v_emails, HOLDS_SLOT).select(
        "mailbox_id", F.date_format("latest_slot", "yyyy-MM-dd").alias("latest"))


@query("search_businesses", "F20", """
SELECT id, name FROM {v_businesses} WHERE contains(lower(name), '#00000010') OR contains(lower(coalesce(city, '')), '#00000010')
 OR contains(lower(coalesce(website_url, '')), '#00000010')""")
def search_businesses(v):
    return reports.search_text(v.v_businesses, ["name", "city", "website_url"], "  #00000010 ").select("id", "name")


@query("browse_page", "S21 O2 O6", """
SELECT id, name, category FROM {v_businesses} WHERE google_review_count >= 200 AND contains(lower(category), 'build')
ORDER BY google_review_count DESC, id LIMIT 50 OFFSET 50""")
def browse_page(v):
    return reports.browse(v.v_businesses, {"google_review_count__gte": 200, "category__icontains": "BUILD"},
                          order=[F.desc("google_review_count"), F.asc("id")], page=2).select("id", "name", "category")


@query("profiles_in_stored_order", "O1 O2", """
SELECT business_id, row_number() OVER (ORDER BY qualification_score DESC NULLS FIRST, business_id) AS position FROM {v_website_profiles}""")
def profiles_in_stored_order(v):
    """The place of every profile in the stored order; no task sorts more than a block of one score."""
    from leadloom.scale import positions, with_block
    rows = with_block(v.v_website_profiles, F.col("business_id"))
    placed = positions(rows, [], reports.DEFAULT_ORDER["website_profiles"](), [-F.coalesce("qualification_score", F.lit(1000)), F.col("__part")])
    return placed.select("business_id", (F.col("position") + 1).alias("position"))


@query("worklist_counts", "F29", f"""
WITH j AS ({JOINED}), ready AS ({READY}), latest AS ({LATEST})
SELECT * FROM (
SELECT 0 AS position, 'emails waiting for review' AS label, count(*) AS n FROM {{v_emails}} WHERE status = 'in_review'
UNION ALL SELECT 1, 'follow-ups to write', count(*) FROM {{v_prospects}} p JOIN latest l ON l.prospect_id = p.id
  JOIN {{v_follow_ups}} f ON f.sequence_id = p.email_sequence_id AND f.sequence = l.sequence_step AND f.template_id IS NOT NULL
  WHERE NOT p.do_not_contact AND p.sequence_stopped_at IS NULL AND NOT any_replied AND l.status IN ('sent', 'opened') AND l.sent_at IS NOT NULL
UNION ALL SELECT 2, 'businesses to review', count(*) FROM j WHERE {NEEDS_REVIEW}
UNION ALL SELECT 3, 'approved emails not queued', count(*) FROM {{v_emails}} WHERE status = 'approved'
UNION ALL SELECT 4, 'emails that failed', count(*) FROM {{v_emails}} WHERE status = 'failed'
UNION ALL SELECT 5, 'queued emails', count(*) FROM {{v_emails}} WHERE status = 'queued'
UNION ALL SELECT 6, 'addresses waiting for a score', count(*) FROM {{v_prospects}} WHERE outreach_status = 'pending'
  AND email_scored_at IS NULL AND NOT do_not_contact AND email_status IS NOT NULL
UNION ALL SELECT 7, 'prospects to review', count(*) FROM {{v_prospects}} WHERE outreach_status = 'needs_review' AND NOT do_not_contact
UNION ALL SELECT 8, 'ready prospects without email', count(*) FROM ready WHERE id NOT IN (SELECT prospect_id FROM {{v_emails}})
UNION ALL SELECT 9, 'contacts to verify', count(*) FROM {{v_contacts}} WHERE email_status IS NULL OR email_status IN ('unverified', 'unknown')
UNION ALL SELECT 10, 'businesses without decision maker', count(*) FROM j WHERE {QUALIFIED}
  AND (NOT has_profile OR contact_discovery_status IS NULL)
UNION ALL SELECT 11, 'businesses without review count', count(*) FROM {{v_businesses}} WHERE google_review_count IS NULL
UNION ALL SELECT 12, 'websites to research', count(*) FROM j WHERE coalesce(website_url, '') <> '' AND (NOT has_profile OR profile_status = 'pending')
UNION ALL SELECT 13, 'failed research', count(*) FROM {{v_website_profiles}} WHERE status = 'failed'
UNION ALL SELECT 14, 'emails left half-sent', count(*) FROM {{v_emails}} WHERE status = 'sending'
UNION ALL SELECT 15, 'campaigns', count(*) FROM {{v_campaigns}}) w""")
def worklist_counts(v):
    n = F.count("*").alias("n")
    mail = v.v_emails.agg(*[F.count_if(F.col("status") == s).alias(s) for s in
                            ("in_review", "approved", "failed", "queued", "sending")])
    people = v.v_prospects.agg(
        F.count_if((F.col("outreach_status") == "pending") & F.col("email_scored_at").isNull() & ~F.col("do_not_contact")
                   & F.col("email_status").isNotNull()).alias("score"),
        F.count_if((F.col("outreach_status") == "needs_review") & ~F.col("do_not_contact")).alias("review"))
    open_search = ~F.col("has_profile") | F.col("contact_discovery_status").isNull()
    unread = ~F.col("has_profile") | (F.col("profile_status") == "pending")
    firms = joined(v).agg(
        F.count_if(qualify.needs_review()).alias("review"), F.count_if(qualify.is_qualified() & open_search).alias("discover"),
        F.count_if(F.col("google_review_count").isNull()).alias("missing"),
        F.count_if(qualify.has_website() & unread).alias("research"), F.count_if(F.col("profile_status") == "failed").alias("failed"))
    status = F.col("email_status")
    unchecked = v.v_contacts.where(status.isNull() | status.isin("unverified", "unknown"))
    unwritten = ready_prospects(v.v_prospects, v.v_emails).join(v.v_emails.select(F.col("prospect_id").alias("id")), "id", "left_anti")
    return reports.stacked([
        (mail, {0: ("emails waiting for review", "in_review"), 3: ("approved emails not queued", "approved"), 4: ("emails that failed", "failed"),
                5: ("queued emails", "queued"), 14: ("emails left half-sent", "sending")}),
        (lifecycle.follow_ups_due(v.v_prospects, v.v_emails, v.v_follow_ups).agg(n), {1: ("follow-ups to write", "n")}),
        (people, {6: ("addresses waiting for a score", "score"), 7: ("prospects to review", "review")}),
        (unwritten.agg(n), {8: ("ready prospects without email", "n")}), (unchecked.agg(n), {9: ("contacts to verify", "n")}),
        (firms, {2: ("businesses to review", "review"), 10: ("businesses without decision maker", "discover"),
                 11: ("businesses without review count", "missing"), 12: ("websites to research", "research"), 13: ("failed research", "failed")}),
        (v.v_campaigns.agg(n), {15: ("campaigns", "n")})])


@query("step_outcomes", "A21", """
WITH log AS (SELECT cast(user_id AS bigint) AS run_id, s.position, s.step,
    max(CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'partial' ELSE 'ok' END) AS outcome, cast(sum(event_id % 5) AS bigint) AS remaining,
    bool_or(event_type = 'error') AS failed
  FROM {events} JOIN (VALUES (0, 'fetch'), (1, 'research'), (2, 'stakeholders'), (3, 'verify'), (4, 'generate'), (5, 'followups')) s(position, step)
    ON s.position = event_id % 6 GROUP BY 1, 2, 3),
runs AS (SELECT run_id, min(CASE WHEN failed THEN position END) AS stopped_at FROM log GROUP BY 1)
SELECT r.run_id, s.position, s.step, CASE WHEN s.position > stopped_at THEN 'not run' WHEN s.position = stopped_at THEN 'stopped'
  ELSE coalesce(outcome, 'not run') END AS state, coalesce(remaining, 0) AS remaining
FROM runs r CROSS JOIN (VALUES (0, 'fetch'), (1, 'research'), (2, 'stakeholders'), (3, 'verify'), (4, 'generate'), (5, 'followups')) s(position, step)
LEFT JOIN log l ON l.run_id = r.run_id AND l.step = s.step""")
def step_outcomes(v):
    steps = ["fetch", "research", "stakeholders", "verify", "generate", "followups"]
    number = (F.col("event_id") % 6).cast("int")
    log = v.events.select(
        F.col("user_id").cast("long").alias("run_id"), F.get(F.array(*[F.lit(s) for s in steps]), number).alias("step"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "partial").otherwise("ok").alias("outcome"),
        (F.col("event_id") % 5).alias("remaining"))
    return reports.step_outcomes(log, steps)


@query("research_fields", "A13", """
SELECT 'field_' || (c_custkey % 30) AS name,
  min_by('From research: about ' || c_mktsegment || ' ' || c_custkey, c_custkey) AS description
FROM {customer} WHERE 'field_' || (c_custkey % 30) <> 'field_3' GROUP BY 1""")
def research_fields(v):
    field = F.struct(F.concat(F.lit("field_"), (F.col("c_custkey") % 30).cast("string")).alias("name"), F.lit("text").alias("type"),
                     F.concat(F.lit("about "), "c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string")).alias("description"))
    prompts = v.customer.select(F.col("c_custkey").alias("id"), F.array(field).alias("output_fields"))
    return reports.research_fields(prompts, ("field_3",))
