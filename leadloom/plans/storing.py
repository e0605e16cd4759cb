"""Merge, constraint and backfill queries."""

import uuid

from pyspark.sql import functions as F

from leadloom.operators import tables
from leadloom.plans.registry import query
from leadloom.plans.reporting import NOW
from leadloom.plans.verifying import _CHECKS, _NOTE_A, _STATUS_A, _VERDICT_A, checks
from leadloom.session import ensure_checkpoint_dir
from leadloom.sources import people, report

_SOURCES = "('website', 'search', 'inferred', 'pattern', 'hunter')"


@query("replace_owned", "S13", f"""
SELECT id, email_source FROM {{v_contacts}} WHERE business_id % 3 <> 0 OR NOT (email_source IS NULL OR email_source IN {_SOURCES})
UNION ALL SELECT id + 1000000000, 'website' FROM {{v_contacts}} WHERE business_id % 6 = 0""")
def replace_owned(v):
    new = v.v_contacts.where(F.col("business_id") % 6 == 0).select((F.col("id") + 1000000000).alias("id"), "business_id", F.lit("website").alias("email_source"))
    processed = v.v_businesses.where(F.col("id") % 3 == 0).select(F.col("id").alias("business_id"))
    return tables.replace_owned(v.v_contacts, new, processed).select("id", "email_source")


@query("discovery_status", "S13", """
SELECT id AS business_id, CASE WHEN id % 6 = 0 AND id IN (SELECT business_id FROM {v_contacts}) THEN 'completed' ELSE 'no_contacts' END AS contact_discovery_status
FROM {v_businesses} WHERE id % 3 = 0""")
def discovery_status(v):
    new = v.v_contacts.where(F.col("business_id") % 6 == 0).select("business_id")
    return tables.discovery_status(v.v_businesses.where(F.col("id") % 3 == 0).select(F.col("id").alias("business_id")), new)


def _old_and_new(v):
    """The first three quarters are stored, the last three quarters were verified now."""
    part = F.col("id") % 4
    existing = v.v_prospects.where(part < 3).withColumn("verification_note", F.lit("old"))
    outcomes = v.v_prospects.where(part > 0).select(
        "id", "contact_id", "email", "business_id", F.when(F.col("id") % 7 < 4, "deliverable").otherwise("risky").alias("email_status"),
        F.lit("checked").alias("verification_note"), F.when(F.col("id") % 7 < 4, "pending").otherwise("needs_review").alias("outreach_status"),
        F.lit(False).alias("do_not_contact"))
    unique = outcomes.groupBy("contact_id", "email").agg(F.max_by(F.struct(*[c for c in outcomes.columns if c not in ("contact_id", "email")]), "id").alias("r"))
    stored = existing.groupBy("contact_id", "email").agg(F.min_by(F.struct(*[c for c in existing.columns if c not in ("contact_id", "email")]), "id").alias("r"))
    return stored.select("contact_id", "email", "r.*").select(*existing.columns), unique.select("contact_id", "email", "r.*")


@query("upsert_prospects", "S14", """
WITH e AS (SELECT DISTINCT ON (contact_id, email) * FROM {v_prospects} WHERE id % 4 < 3 ORDER BY contact_id, email, id),
n AS (SELECT DISTINCT ON (contact_id, email) id, contact_id, email, CASE WHEN id % 7 < 4 THEN 'deliverable' ELSE 'risky' END AS email_status,
   CASE WHEN id % 7 < 4 THEN 'pending' ELSE 'needs_review' END AS outreach_status FROM {v_prospects} WHERE id % 4 > 0 ORDER BY contact_id, email, id DESC)
SELECT coalesce(e.id, n.id) AS id, coalesce(e.contact_id, n.contact_id) AS contact_id, coalesce(n.email_status, e.email_status) AS email_status,
 CASE WHEN n.id IS NULL THEN 'old' ELSE 'checked' END AS verification_note,
 CASE WHEN e.id IS NULL THEN n.outreach_status WHEN n.id IS NULL OR e.do_not_contact THEN e.outreach_status
  WHEN n.outreach_status = 'pending' AND e.email_score IS NOT NULL THEN CASE WHEN n.email_status = 'deliverable' AND e.email_score >= 60 THEN 'ready' ELSE 'needs_review' END
  ELSE n.outreach_status END AS outreach_status
FROM e FULL JOIN n ON n.contact_id = e.contact_id AND n.email = e.email""")
def upsert_prospects(v):
    existing, outcomes = _old_and_new(v)
    return tables.upsert_prospects(existing, outcomes, 60).select("id", "contact_id", "email_status", "verification_note", "outreach_status")


@query("upsert_drafts", "S15", """
SELECT coalesce(e.id, n.id) AS id, coalesce(e.prospect_id, n.prospect_id) AS prospect_id, CASE WHEN e.id IS NULL OR (n.id IS NOT NULL AND e.status = 'in_review') THEN 'in_review' ELSE e.status END AS status,
 CASE WHEN e.id IS NULL OR (n.id IS NOT NULL AND e.status = 'in_review') THEN 'New subject' ELSE e.subject END AS subject
FROM (SELECT * FROM {v_emails} WHERE id % 3 < 2) e FULL JOIN (SELECT id, prospect_id, sequence_step FROM {v_emails} WHERE id % 3 > 0) n
  ON n.prospect_id = e.prospect_id AND n.sequence_step = e.sequence_step""")
def upsert_drafts(v):
    drafts = v.v_emails.where(F.col("id") % 3 > 0).select("id", "prospect_id", "sequence_step", F.lit("New subject").alias("subject"))
    return tables.upsert_drafts(v.v_emails.where(F.col("id") % 3 < 2), drafts).select("id", "prospect_id", "status", "subject")


@query("merge_candidate_checks", "S17", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'risky' ELSE 'unverified' END AS email_status,
 CASE WHEN c_custkey % 4 = 0 THEN 'risky' ELSE '-' END || ',' || CASE WHEN c_custkey % 4 = 0 THEN 'safe' ELSE '-' END || ',-' AS checks FROM {customer}""")
def merge_candidate_checks(v):
    key = F.col("c_custkey").cast("string")
    element = lambda a: F.struct(a.alias("email"), F.lit(None).cast("string").alias("check"), F.lit(None).cast("timestamp").alias("checked_at"))
    own, other = F.concat(F.lit("ann@b"), key, F.lit(".org")), F.concat(F.lit("Lee@B"), key, F.lit(".org"))
    contacts = v.customer.select(F.col("c_custkey").alias("id"), own.alias("email"), F.lit("unverified").alias("email_status"), F.lit(None).cast("timestamp").alias("email_checked_at"),
                                 F.array(element(F.concat(F.lit(" "), F.upper(own))), element(other), element(F.lit("x@y.org"))).alias("candidate_emails"))
    checked = v.customer.where(F.col("c_custkey") % 4 == 0)
    outcome = F.explode(F.array(F.struct(own.alias("address"), F.lit("risky").alias("check"), F.lit("risky").alias("status")),
                                F.struct(F.lower(other).alias("address"), F.lit("safe").alias("check"), F.lit("deliverable").alias("status"))))
    outcomes = checked.select(F.col("c_custkey").alias("contact_id"), outcome.alias("o")).select("contact_id", "o.*", F.lit(NOW).alias("checked_at"))
    merged = tables.merge_candidate_checks(contacts, outcomes)
    return merged.select("id", "email_status", F.array_join(F.transform("candidate_emails", lambda c: F.coalesce(c["check"], F.lit("-"))), ",").alias("checks"))


def _deleted(v):
    usage = v.v_usage.select("id", "business_id")
    named = {"businesses": v.v_businesses, "contacts": v.v_contacts, "prospects": v.v_prospects, "emails": v.v_emails_of, "usage_records": usage}
    return tables.cascade_delete(named, "businesses", v.v_businesses.where(F.col("id") % 5 == 0).select("id"))


@query("cascade_delete", "S18", """
SELECT 'businesses' AS name, count(*) AS n, cast(sum(id) AS bigint) AS ids, count(*) AS kept FROM {v_businesses} WHERE id % 5 <> 0
UNION ALL SELECT 'contacts', count(*), cast(sum(id) AS bigint), count(business_id) FROM {v_contacts} WHERE business_id % 5 <> 0
UNION ALL SELECT 'prospects', count(*), cast(sum(id) AS bigint), count(business_id) FROM {v_prospects} WHERE business_id % 5 <> 0
UNION ALL SELECT 'emails', count(*), cast(sum(id) AS bigint), count(business_id) FROM {v_emails_of} WHERE business_id % 5 <> 0
UNION ALL SELECT 'usage_records', count(*), cast(sum(id) AS bigint), count(CASE WHEN business_id % 5 <> 0 OR business_id NOT IN (SELECT id FROM {v_businesses}) THEN 1 END) FROM {v_usage}""")
def cascade_delete(v):
    result = None
    for name, df in _deleted(v).items():
        owner = F.col("id") if name == "businesses" else F.col("business_id")
        row = df.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count(owner).alias("kept")).select(F.lit(name).alias("name"), "n", "ids", "kept")
        result = row if result is None else result.unionByName(row)
    return result


@query("constraint_report", "S19", """
SELECT 'emails' AS "table", 'status' AS rule, count(*) FILTER (status NOT IN ('in_review', 'approved', 'queued', 'sending', 'failed', 'rejected', 'sent', 'opened', 'replied')) AS violations FROM {v_emails}
UNION ALL SELECT 'emails', 'unique prospect_id, sequence_step', count(*) - count(DISTINCT (prospect_id, sequence_step)) FROM {v_emails}
UNION ALL SELECT 'prospects', 'email_length', count(*) FILTER (length(email) > 320) FROM {v_prospects}
UNION ALL SELECT 'prospects', 'email_score', count(*) FILTER (email_score < 0 OR email_score > 100) FROM {v_prospects}
UNION ALL SELECT 'prospects', 'unique contact_id, email', count(*) - count(DISTINCT (contact_id, email)) FROM {v_prospects}
UNION ALL SELECT 'businesses', 'unique google_place_id', (SELECT cast(sum(n - 1) AS bigint) FROM (SELECT count(*) AS n FROM {v_listings} WHERE place_id IS NOT NULL GROUP BY place_id) x)
UNION ALL SELECT 'businesses', 'name_length', count(*) FILTER (length(name) > 255) FROM {v_listings}
UNION ALL SELECT 'follow_ups', 'sequence', count(*) FILTER (sequence < 1) FROM {v_follow_ups}
UNION ALL SELECT 'follow_ups', 'days', count(*) FILTER (days_after_previous < 1) FROM {v_follow_ups}
UNION ALL SELECT 'follow_ups', 'unique sequence_id, sequence', count(*) - count(DISTINCT (sequence_id, sequence)) FROM {v_follow_ups}""")
def constraint_report(v):
    listed = v.v_listings.withColumnRenamed("place_id", "google_place_id")
    parts = [tables.check_constraints(v.v_emails, "emails"), tables.check_constraints(v.v_prospects, "prospects"),
             tables.check_constraints(listed, "businesses"), tables.check_constraints(v.v_follow_ups, "follow_ups")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("defaults_applied", "S20", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'ready' END AS outreach_status, o_orderkey % 2 = 0 AS do_not_contact, 0 AS facts FROM {orders}""")
def defaults_applied(v):
    key = F.col("o_orderkey")
    raw = v.orders.select(key.alias("id"), F.when(key % 3 != 0, "ready").alias("outreach_status"), F.when(key % 2 == 0, True).alias("do_not_contact"),
                          F.lit(None).cast("array<string>").alias("outreach_facts"))
    return tables.apply_defaults(raw, "prospects", NOW).select("id", "outreach_status", "do_not_contact", F.size("outreach_facts").alias("facts"))


@query("touched_rows", "S20", """
SELECT id, strftime(CASE WHEN id % 4 = 0 AND category <> 'BUILDING' THEN timestamp '2024-01-02 12:00:00' ELSE timestamp '2023-01-01' END, '%Y-%m-%d') AS updated FROM {v_businesses}""")
def touched_rows(v):
    import datetime as dt
    before = v.v_businesses.select("id", "category", F.lit(dt.datetime(2023, 1, 1)).alias("updated_at"))
    after = before.withColumn("category", F.when(F.col("id") % 4 == 0, "BUILDING").otherwise(F.col("category")))
    return tables.touch(before, after, "id", NOW).select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


_SETUP = """SELECT c_custkey AS id, concat('Campaign ', cast(c_custkey % 300 AS string)) AS name FROM {customer}"""
_INITIALS = """SELECT c.c_custkey AS campaign_id, cast(n.n_nationkey AS bigint) AS template_id, n.n_name AS template_name
FROM {customer} AS c JOIN {nation} AS n ON n.n_nationkey % 12 = c.c_custkey % 12 WHERE c.c_custkey % 12 < 8"""
_STEPS = """SELECT c_custkey AS campaign_id, 1 AS sequence, 3 AS days, cast(7 AS bigint) AS template_id FROM {customer} WHERE c_custkey % 12 > 5 AND c_custkey % 12 < 10"""


@query("setup_to_sequences", "M13", f"""
WITH c AS ({_SETUP}), i AS ({_INITIALS}), s AS ({_STEPS}), k AS (SELECT campaign_id, count(*) AS n FROM i GROUP BY 1),
e AS (SELECT i.campaign_id, i.template_id, i.template_name, k.n, c.name FROM i JOIN k USING (campaign_id) JOIN c ON c.id = i.campaign_id
  UNION ALL SELECT s.campaign_id, NULL, NULL, 0, c.name FROM s JOIN c ON c.id = s.campaign_id WHERE s.campaign_id NOT IN (SELECT campaign_id FROM i)),
b AS (SELECT *, CASE WHEN n <= 1 THEN name ELSE name || ' - ' || template_name END AS base FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY campaign_id, template_name) AS nth FROM b)
SELECT r.campaign_id, template_id, CASE WHEN nth = 1 THEN base ELSE base || ' (' || nth || ')' END AS name, (SELECT count(*) FROM s WHERE s.campaign_id = r.campaign_id) AS steps FROM r""")
def setup_to_sequences(v):
    sequences, copied = tables.setup_to_sequences(v.sql(_SETUP), v.sql(_INITIALS), v.sql(_STEPS))
    steps = copied.groupBy("name").agg(F.count("*").alias("steps"))
    return sequences.join(steps, "name", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))


_PROMPTS = """SELECT p_partkey AS id, p_partkey % 200 AS owner_id, concat('Owner ', cast(p_partkey % 200 AS string)) AS owner, p_name AS name,
 p_partkey % 3 AS sequence, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS variation, p_partkey % 7 = 0 AS is_default, p_size % 2 = 0 AS opened FROM {part}"""


@query("prompts_to_kinds", "M16", f"""
WITH p AS ({_PROMPTS}), f AS (SELECT *, min(id) OVER (PARTITION BY name) AS first FROM p),
o AS (SELECT *, CASE WHEN id <> first THEN name || ' (' || owner || ')' END AS owned FROM f),
u AS (SELECT *, CASE WHEN owned IS NULL THEN name WHEN id = min(id) OVER (PARTITION BY owned) THEN owned ELSE owned || ' #' || id END AS unique_name FROM o),
g AS (SELECT *, row_number() OVER (PARTITION BY owner_id, CASE WHEN sequence = 0 THEN 'v' || variation ELSE 's' || sequence END ORDER BY is_default DESC, opened, id) AS rn FROM u)
SELECT id, CASE WHEN sequence = 0 THEN 'initial' ELSE 'follow_up' END AS kind, unique_name, rn = 1 AS best FROM g""")
def prompts_to_kinds(v):
    return tables.prompts_to_kinds(v.sql(_PROMPTS))


@query("simple_backfills", "M14", """
SELECT p.id, coalesce(verdict, CASE WHEN email_status = 'deliverable' THEN 'deliverable' END) AS verdict, c.min_score AS threshold,
 CASE WHEN p.id % 3 <> 0 THEN '{"team_size":' || CASE WHEN p.id % 3 = 1 THEN cast(p.id AS varchar) ELSE 'null' END || ',"languages":["English"]}' END AS extracted,
 'Qualify' || chr(10) || chr(10) || 'Dear you, ' || p.id AS prompt
FROM {v_prospects} p JOIN (SELECT id, CASE WHEN min_score + 30 = 70 THEN 40 ELSE min_score + 30 END AS min_score FROM {v_campaigns}) c ON c.id = p.business_id % 25""")
def simple_backfills(v):
    people_ = tables.backfill_verdict(v.v_prospects)
    campaigns = tables.backfill_threshold(v.v_campaigns.withColumn("min_score", F.col("min_score") + 30))
    key = F.col("id")
    rows = people_.join(campaigns.select((F.col("id")).alias("owner_id"), F.col("min_score").alias("threshold")), F.col("owner_id") == F.col("business_id") % 25)
    rows = rows.withColumns({"team_size": F.when(key % 3 == 1, key), "languages": F.when(key % 3 != 0, F.array(F.lit("English"))),
                             "prompt": F.concat(F.lit(" Dear {{name}}, "), key.cast("string"), F.lit(" "))})
    rows = tables.replace_phrase(tables.backfill_extracted(rows), "prompt", "{{name}}", "you")
    owners = v.v_campaigns.select("id", F.lit(" Qualify ").alias("prompt"))
    return tables.prepend_owner_text(rows, owners).select("id", "verdict", "threshold", "extracted", "prompt")


@query("verification_report", "S12", f"""
SELECT position AS contact_id, run_id AS business_id, address AS email, {_STATUS_A} AS status, {_VERDICT_A} AS verdict, true AS probed,
 CASE WHEN k <> 12 THEN k = 5 END AS catch_all, CASE WHEN k <> 12 THEN is_role_account END AS role_account,
 coalesce({_NOTE_A}, '') || CASE WHEN position % 3 = 0 THEN ', "' || run_id || '"' || chr(10) || 'next' ELSE '' END AS note FROM ({_CHECKS}) c""")
def verification_report(v):
    """The report of all checks, written and read back; some notes have commas, quotes and line breaks."""
    spark = v.orders.sparkSession
    more = F.when(F.col("position") % 3 == 0, F.concat(F.lit(', "'), F.col("run_id").cast("string"), F.lit('"\nnext'))).otherwise("")
    outcomes = checks(v).withColumns({"contact_id": F.col("position"), "business_id": F.col("run_id"), "probed": F.lit(True),
                                      "note": F.concat(F.coalesce("note", F.lit("")), more)})
    folder = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    report.write_report(outcomes, folder)
    return report.read_report(spark, folder)


@query("domain_people", "S4", """
WITH o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderpriority AS p, o_orderstatus AS s, cast(o_orderkey % 160 - 30 AS double) AS c FROM {orders})
SELECT o_custkey + 1000000000 AS business_id, i AS pos, s || k || '@b.org' AS email, CASE k % 3 WHEN 0 THEN s || ' ' || p WHEN 1 THEN p ELSE s || k || '@b.org' END AS name,
 nullif(trim(regexp_replace(p, '[- ]+', ' ', 'g')), '') AS position, cast(least(greatest(c, 0), 100) / 100 AS decimal(4, 3)) AS confidence, k % 4 AS n_sources FROM o WHERE k % 5 <> 0
UNION ALL SELECT c_custkey AS business_id, i AS pos, 'P' || i || '@b' || c_custkey || '.org' AS email, CASE i WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo' WHEN 2 THEN 'P2@b' || c_custkey || '.org' END AS name,
 CASE i WHEN 0 THEN 'Clinic Owner' END AS position, cast(CASE i WHEN 0 THEN 0.95 WHEN 1 THEN 1 ELSE 0 END AS decimal(4, 3)) AS confidence, CASE WHEN i = 0 THEN 1 ELSE 0 END AS n_sources FROM {customer}, range(0, 3) r(i)""")
def domain_people(v):
    key = F.col("c_custkey").cast("string")
    text = lambda x: F.lit(x).cast("string")
    entry = lambda i, first, last, position, confidence, uris: F.struct(
        F.concat(F.lit(f" P{i}@b"), key, F.lit(".org")).alias("value"), text(first).alias("first_name"), text(last).alias("last_name"), text(position).alias("position"),
        F.lit(confidence).alias("confidence"), text("generic" if i == 2 else "personal").alias("type"), text("senior").alias("seniority"),
        F.array(*[F.struct(text(u).alias("uri")) for u in uris]).alias("sources"))
    junk = F.struct(text("no address").alias("value"), text("X").alias("first_name"), text(None).alias("last_name"), text(None).alias("position"), F.lit(5).alias("confidence"),
                    text("personal").alias("type"), text(None).alias("seniority"), F.array(F.struct(text(None).alias("uri"))).alias("sources"))
    answer = F.struct(F.array(entry(0, "Ann", " Lee", "Clinic   Owner", 95, ["https://a.org"]), entry(1, " Bo ", None, "", 250, [None]),
                              entry(2, None, "", None, -3, [""]), junk).alias("emails"))
    responses = v.customer.select(F.col("c_custkey").alias("business_id"), F.to_json(answer).alias("raw"))
    # the orders of a customer as one answer about its people; every fifth has no address
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    uris = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.when(i <= k % 4, F.concat(F.lit("https://s.org/"), i.cast("string"))).otherwise("").alias("uri")))
    person = F.struct(k.alias("k"), F.concat(F.lit("  "), status, k.cast("string"), F.when(k % 5 != 0, "@").otherwise(" at "), F.lit("b.org ")).alias("value"),
                      F.when(k % 3 == 0, status).when(k % 3 == 1, " ").alias("first_name"), F.when(k % 3 < 2, F.concat(F.lit(" "), priority)).alias("last_name"),
                      F.regexp_replace(priority, "-", "  ").alias("position"), (k % 160 - 30).alias("confidence"), F.lit("personal").alias("type"), uris.alias("sources"))
    told = v.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(person)).alias("emails"))
    responses = responses.unionByName(told.select((F.col("o_custkey") + 1_000_000_000).alias("business_id"), F.to_json(F.struct("emails")).alias("raw")))
    return people.ingest_domain_people(responses).select("business_id", "pos", "email", "name", "position", "confidence", F.size("source_urls").alias("n_sources"))


@query("search_results", "S7 O5", """
SELECT conv_id, n - 1 AS rank, url FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'https://r.org/' || turn AS url FROM {conversations} WHERE turn % 5 <> 4) x WHERE n <= 10""")
def search_results(v):
    item = F.struct("turn", F.when(F.col("turn") % 5 != 4, F.concat(F.lit("https://r.org/"), F.col("turn").cast("string"))).alias("url"), F.col("role").alias("title"),
                    F.col("text").alias("content"), F.lit("e").alias("engine"))
    answers = v.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("results"))).alias("raw"))
    return people.ingest_search_results(answers).select("conv_id", "rank", "url")
