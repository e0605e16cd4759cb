"""Verification and scoring queries."""


from pyspark.sql import functions as F

from leadloom.operators import verify
from leadloom.plans.registry import query
from leadloom.plans.reporting import NOW
from leadloom.plans.views import EXCLUDED_PATTERNS
from leadloom.sources import verifier

# One verifier answer per order: thirteen scenarios in turn, twenty addresses per domain.
_CHECKS = """SELECT o_orderkey AS position, o_custkey % 50 AS run_id,
 concat('a', cast(o_orderkey AS string), '@Dom', cast(o_orderkey % 1000 AS string), '.org') AS address, o_orderkey % 13 AS k,
 CASE WHEN o_orderkey % 13 = 0 THEN 'safe' WHEN o_orderkey % 13 < 5 THEN 'invalid' WHEN o_orderkey % 13 < 9 THEN 'risky' WHEN o_orderkey % 13 < 12 THEN 'unknown' END AS is_reachable,
 CASE WHEN o_orderkey % 13 IN (2, 4, 12) THEN NULL ELSE o_orderkey % 13 <> 11 END AS can_connect_smtp,
 o_orderkey % 13 = 5 AS is_catch_all, o_orderkey % 13 = 6 AS has_full_inbox, o_orderkey % 13 = 3 AS is_disabled, o_orderkey % 13 <> 2 AS accepts_mail,
 o_orderkey % 13 = 7 AS is_disposable, o_orderkey % 13 <> 4 AS valid_syntax, o_orderkey % 2 = 0 AS is_role_account,
 CASE o_orderkey % 13 WHEN 9 THEN 'permanent: no' WHEN 10 THEN 'Transient: later' END AS smtp_error
FROM {orders}"""

_VERDICT_A = """CASE k WHEN 0 THEN 'deliverable' WHEN 1 THEN 'mailbox_not_found' WHEN 2 THEN 'no_mail_server' WHEN 3 THEN 'disabled'
 WHEN 4 THEN 'invalid_syntax' WHEN 5 THEN 'catch_all' WHEN 6 THEN 'full_inbox' WHEN 7 THEN 'disposable' WHEN 8 THEN 'risky' WHEN 9 THEN 'blocked'
 WHEN 10 THEN 'temporary_failure' WHEN 11 THEN 'smtp_unreachable' ELSE 'check_failed' END"""
_STATUS_A = "CASE WHEN k = 0 THEN 'deliverable' WHEN k < 5 THEN 'undeliverable' WHEN k < 9 THEN 'risky' ELSE 'unknown' END"
_NOTE_A = """CASE k WHEN 1 THEN 'mail server says this mailbox does not exist' WHEN 2 THEN 'domain has no mail server' WHEN 3 THEN 'mailbox is disabled'
 WHEN 4 THEN 'invalid syntax' WHEN 5 THEN 'domain accepts mail for any address (catch-all); existence cannot be proven' WHEN 6 THEN 'mailbox exists but is full'
 WHEN 7 THEN 'disposable email domain' WHEN 8 THEN 'Reacher rated this address risky (deliverability not certain)' WHEN 9 THEN 'permanent: no'
 WHEN 10 THEN 'Transient: later' WHEN 11 THEN 'Reacher could not verify this address (server unreachable, blocked or greylisted)'
 WHEN 12 THEN 'Reacher could not verify this address (server unreachable, blocked or greylisted)' END"""


def _answers(v):
    """What the verifier answered per address; NULL when it did not answer."""
    answer = F.struct(
        "is_reachable", F.struct("is_disposable", "is_role_account").alias("misc"),
        F.struct("accepts_mail", F.struct(F.lit(None).cast("string").alias("message")).alias("error")).alias("mx"),
        F.struct("can_connect_smtp", "has_full_inbox", "is_catch_all", (F.col("k") == 0).alias("is_deliverable"), "is_disabled",
                 F.struct(F.col("smtp_error").alias("message")).alias("error")).alias("smtp"),
        F.struct(F.col("valid_syntax").alias("is_valid_syntax")).alias("syntax"))
    return v.sql(_CHECKS).select("position", "run_id", "address", F.when(F.col("k") != 12, answer).alias("response"))


def checks(v):
    return verifier.outcome_a(_answers(v))


@query("verdicts", "S5 X21", f"""
SELECT position, {_STATUS_A} AS status, {_VERDICT_A} AS verdict, {_NOTE_A} AS note, k IN (10, 11, 12) AS retryable,
 CASE WHEN k <> 12 THEN is_role_account END AS is_role_account FROM ({_CHECKS}) c""")
def verdicts(v):
    sent = _answers(v).withColumn("raw", F.to_json("response")).drop("response")  # as it arrives: one JSON text per address
    parsed = sent.withColumn("response", F.from_json("raw", verifier.RESPONSE_A)).drop("raw")
    return verifier.outcome_a(parsed).select("position", "status", "verdict", "note", "retryable", "is_role_account")


@query("verdicts_b", "S6 X22", """
SELECT position, CASE k WHEN 0 THEN 'deliverable' WHEN 1 THEN 'undeliverable' WHEN 2 THEN 'undeliverable' WHEN 3 THEN 'undeliverable' WHEN 4 THEN 'risky'
  WHEN 6 THEN 'undeliverable' ELSE 'unknown' END AS status,
 CASE k WHEN 0 THEN 'deliverable' WHEN 1 THEN 'mailbox_not_found' WHEN 2 THEN 'invalid_syntax' WHEN 3 THEN 'no_mail_server' WHEN 4 THEN 'catch_all'
  WHEN 5 THEN 'webmail' WHEN 6 THEN 'disposable' WHEN 7 THEN 'unknown' WHEN 8 THEN 'blocked' ELSE 'check_failed' END AS verdict,
 CASE k WHEN 0 THEN NULL WHEN 1 THEN 'Hunter: the mail server says this mailbox does not exist' WHEN 2 THEN 'Hunter: not a valid email address'
  WHEN 3 THEN 'Hunter: the domain has no mail server' WHEN 4 THEN 'Hunter: the domain accepts mail for any address (catch-all); existence cannot be proven'
  WHEN 5 THEN 'Hunter: a webmail address (e.g. gmail.com); Hunter cannot verify these' WHEN 6 THEN 'Hunter: a disposable email address'
  WHEN 7 THEN 'Hunter could not verify this address' WHEN 8 THEN 'Hunter: the mail server blocked the verification'
  ELSE 'Hunter did not finish the verification; try again later' END AS note, k IN (5, 7, 8, 9) AS retryable, k = 4 AS is_catch_all
FROM (SELECT o_orderkey AS position, o_orderkey % 10 AS k FROM {orders}) x""")
def verdicts_b(v):
    k = F.col("o_orderkey") % 10
    status = (F.when(k == 0, "valid").when(k < 4, "invalid").when(k == 4, "accept_all").when(k == 5, "webmail")
              .when(k == 6, "disposable").when(k < 9, "unknown"))
    raw = F.to_json(F.struct(status.alias("status"), (k != 2).alias("regexp"), (k != 3).alias("mx_records"), (k == 8).alias("block")))
    rows = v.orders.select(F.col("o_orderkey").alias("position"), F.from_json(raw, verifier.RESPONSE_B).alias("response"))
    return verifier.outcome_b(rows).drop("probed_status")


@query("outreach_outcomes", "X23", f"""
SELECT position, CASE WHEN k = 0 THEN 'pending' WHEN k < 5 THEN 'rejected' ELSE 'needs_review' END AS with_score,
 CASE WHEN k = 0 THEN 'ready' WHEN k < 5 THEN 'rejected' ELSE 'needs_review' END AS without_score FROM ({_CHECKS}) c""")
def outreach_outcomes(v):
    status, verdict = F.col("status"), F.col("verdict")
    return checks(v).select("position", verify.outreach_for(status, verdict, True).alias("with_score"),
                            verify.outreach_for(status, verdict, False).alias("without_score"))


@query("domain_shortcuts", "J16", f"""
WITH c AS (SELECT *, lower(split_part(address, '@', 2)) AS domain, {_STATUS_A} AS status, {_VERDICT_A} AS verdict, {_NOTE_A} AS note,
  lower(address) LIKE '%7@dom%' AS excluded, position % 1000 < 50 AS known FROM ({_CHECKS}) x),
d AS (SELECT domain, min(position) AS decided_at, min_by(k, position) AS dk FROM c WHERE NOT excluded AND k IN (5, 9, 11, 12) GROUP BY 1),
j AS (SELECT c.*, dk, CASE WHEN excluded THEN 'pattern' WHEN known THEN 'known' WHEN position > decided_at THEN 'run' ELSE 'probe' END AS source
  FROM c LEFT JOIN d ON d.domain = c.domain)
SELECT position, address, source, source = 'probe' AS probed,
 CASE source WHEN 'probe' THEN status WHEN 'known' THEN 'risky' WHEN 'run' THEN CASE WHEN dk = 5 THEN 'risky' ELSE 'unknown' END ELSE 'unknown' END AS status,
 CASE source WHEN 'probe' THEN verdict WHEN 'pattern' THEN 'excluded' WHEN 'known' THEN 'catch_all'
  ELSE CASE dk WHEN 5 THEN 'catch_all' WHEN 9 THEN 'blocked' WHEN 11 THEN 'smtp_unreachable' ELSE 'check_failed' END END AS verdict,
 CASE source WHEN 'probe' THEN note WHEN 'pattern' THEN 'Excluded: matches the pattern *7@dom* (Settings), so it is never emailed.'
  WHEN 'known' THEN 'not checked: the domain accepts mail for any address (catch-all, found in an earlier run)'
  ELSE 'not checked: ' || CASE dk WHEN 5 THEN 'the domain accepts mail for any address (catch-all)' WHEN 9 THEN 'the mail server refused the checks'
   WHEN 11 THEN 'Reacher could not connect to the mail server' ELSE 'the mail server did not answer' END END AS note FROM j""")
def domain_shortcuts(v):
    known = v.orders.where(F.col("o_orderkey") % 1000 < 50).select(
        F.concat(F.lit("dom"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".org")).alias("domain"))
    return verify.shortcut_domains(checks(v), known, ["*7@dom*"])


@query("catch_all_domains", "A19", """
SELECT DISTINCT lower(split_part(email, '@', 2)) AS domain FROM {v_prospects} WHERE verdict = 'catch_all' AND id % 3 <> 0""")
def catch_all_domains(v):
    return verify.catch_all_domains(v.v_prospects.withColumn("probed", F.col("id") % 3 != 0))


@query("failure_streak", "W12", f"""
WITH c AS (SELECT run_id, position, CASE WHEN position % 7 < 4 THEN false WHEN position % 7 = 4 THEN NULL ELSE true END AS ok FROM ({_CHECKS}) x),
r AS (SELECT *, lag(ok, 1) OVER w AS p1, lag(ok, 2) OVER w AS p2 FROM c WHERE ok IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY position))
SELECT run_id, min(position) AS stops_at FROM r WHERE NOT ok AND NOT p1 AND NOT p2 GROUP BY 1""")
def failure_streak(v):
    part = F.col("position") % 7
    rows = v.sql(_CHECKS).select("run_id", "position", F.when(part < 4, False).when(part > 4, True).alias("can_connect_smtp"))
    return verify.failure_streak(rows)


@query("verification_summary", "A14 F10", f"""
SELECT count(*) FILTER (k <> 3) AS checked, count(*) FILTER (k = 0) AS deliverable, count(*) FILTER (k IN (1, 2, 4)) AS undeliverable,
 count(*) FILTER (k BETWEEN 5 AND 8) AS risky, count(*) FILTER (k > 8) AS unknown, count(*) FILTER (k > 4) AS needs_review,
 count(*) FILTER (k = 3) AS skipped FROM ({_CHECKS}) c""")
def verification_summary(v):
    skip = F.col("position") % 13 == 3
    rows = checks(v)
    return verify.verification_summary(rows.where(~skip), rows.where(skip))


@query("excluded_addresses", "F12", """
SELECT id, CASE WHEN lower(email) LIKE 'p1%@%' THEN 'p1*@*' WHEN lower(email) LIKE '%@biz7.%' THEN '*@biz7.*' WHEN lower(email) LIKE 'p9_@%' THEN 'p9?@*' END AS pattern
FROM {v_prospects}""")
def excluded_addresses(v):
    return v.v_prospects.select("id", verify.excluded_pattern(F.upper("email"), EXCLUDED_PATTERNS).alias("pattern"))


@query("apply_exclusions", "F13", """
WITH x AS (SELECT *, outreach_status IN ('pending', 'needs_review', 'ready') AND NOT approved_by_person AND coalesce(verdict, '') <> 'excluded'
  AND (email LIKE 'p1%@%' OR email LIKE '%@biz7.%' OR email LIKE 'p9_@%') AS hit FROM {v_prospects})
SELECT id, CASE WHEN hit THEN 'rejected' ELSE outreach_status END AS outreach_status, CASE WHEN NOT hit THEN email_score END AS email_score,
 hit OR email_scored_at IS NOT NULL AS scored FROM x""")
def apply_exclusions(v):
    return verify.apply_exclusions(v.v_prospects, EXCLUDED_PATTERNS, NOW).select(
        "id", "outreach_status", "email_score", F.col("email_scored_at").isNotNull().alias("scored"))


_SCORING = """NOT do_not_contact AND NOT approved_by_person AND outreach_status IN ('pending', 'needs_review')
 AND email_status IN ('deliverable', 'risky', 'unknown') AND coalesce(verdict, '') <> 'excluded'"""


@query("scoring_queue", "F11", f"SELECT id FROM {{v_prospects}} WHERE {_SCORING} AND email_scored_at IS NULL")
def scoring_queue(v):
    return verify.scoring_queue(v.v_prospects).select("id")


@query("sibling_addresses", "J7", """
SELECT id, coalesce((SELECT string_agg(email || '/' || email_status, ' ' ORDER BY sid) FROM (SELECT o.id AS sid, o.email, o.email_status FROM {v_prospects} o
  WHERE o.business_id = p.business_id AND o.id <> p.id AND coalesce(o.verdict, '') <> 'excluded' ORDER BY o.id LIMIT 12) s), '') AS siblings FROM {v_prospects} p""")
def sibling_addresses(v):
    text = F.transform("siblings", lambda s: F.concat_ws("/", s["address"], s["status"]))
    return verify.sibling_addresses(v.v_prospects).select("id", F.array_join(text, " ").alias("siblings"))


@query("scoring_context", "F23 J7", f"""
SELECT p.id, p.email AS address, b.name AS business, w.qualification_score AS score, c.job_title,
 (SELECT count(*) FROM (SELECT o.id FROM {{v_prospects}} o WHERE o.business_id = p.business_id AND o.id <> p.id AND coalesce(o.verdict, '') <> 'excluded' LIMIT 12) s) AS others
FROM (SELECT * FROM {{v_prospects}} WHERE {_SCORING} AND email_scored_at IS NULL) p JOIN {{v_businesses}} b ON b.id = p.business_id
JOIN {{v_contacts}} c ON c.id = p.contact_id LEFT JOIN {{v_website_profiles}} w ON w.business_id = p.business_id""")
def scoring_context(v):
    context = verify.scoring_context(verify.scoring_queue(v.v_prospects), v.v_prospects, v.v_businesses, v.v_website_profiles, v.v_contacts)
    shape = ("struct<address:string,business:struct<name:string,qualification_score:int>,contact:struct<job_title:string>,"
             "other_addresses_at_this_business:array<struct<address:string>>>")
    read = context.select("id", F.from_json("context", shape).alias("c"))
    return read.select("id", "c.address", F.col("c.business.name").alias("business"), F.col("c.business.qualification_score").alias("score"),
                       "c.contact.job_title", F.size("c.other_addresses_at_this_business").alias("others"))


_SCORES = """SELECT l_orderkey AS id, l_linenumber AS position, (l_orderkey * 7 + l_linenumber * 31) % 140 - 20 AS score,
 CASE WHEN l_linenumber % 2 = 0 THEN '  looks   right ' ELSE 'no' END AS reasoning FROM {lineitem}"""


@query("score_gate", "M10 X23 X24", f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS n FROM ({_SCORES}) r),
f(id, n, outreach_status, email_score, email_score_reason, email_status) AS (
  SELECT id, 0::bigint, outreach_status, email_score, NULL::varchar, email_status FROM {{v_prospects}}
  UNION ALL
  SELECT f.id, c.n, CASE WHEN f.outreach_status IN ('pending', 'needs_review')
      THEN CASE WHEN f.email_status = 'deliverable' AND least(greatest(c.score, 0), 100) >= 60 THEN 'ready' ELSE 'needs_review' END ELSE f.outreach_status END,
    CASE WHEN f.outreach_status IN ('pending', 'needs_review') THEN least(greatest(c.score, 0), 100) ELSE f.email_score END,
    CASE WHEN f.outreach_status IN ('pending', 'needs_review') THEN regexp_replace(trim(c.reasoning), ' +', ' ') ELSE f.email_score_reason END, f.email_status
  FROM f JOIN c ON c.id = f.id AND c.n = f.n + 1)
SELECT id, arg_max(outreach_status, n) AS outreach_status, max_by(struct_pack(v := email_score), n).v AS email_score,
 max_by(struct_pack(v := email_score_reason), n).v AS email_score_reason FROM f GROUP BY id""")
def score_gate(v):
    return verify.apply_scores(v.v_prospects, v.sql(_SCORES), 60, NOW).select("id", "outreach_status", "email_score", "email_score_reason")


@query("verification_queue", "F9 O3", """
SELECT id, business_id FROM {v_contacts} c WHERE EXISTS (SELECT 1 FROM {v_website_profiles} w WHERE w.business_id = c.business_id AND w.qualification_score >= 50)
ORDER BY business_id, is_primary DESC, id LIMIT 100""")
def verification_queue(v):
    return verify.verification_queue(v.v_contacts, v.v_website_profiles, min_score=50, limit=100).select("id", "business_id")


@query("candidate_addresses", "W6 U3", """
WITH c AS (SELECT c_custkey AS id, list_value(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE ' Ann@B' || c_custkey || '.org ' END, 'ann@b' || c_custkey || '.ORG', 'junk', 'info@b.org',
   'p' || c_custkey || '@b.org', 'INFO@b.org', 'last@b.org', '') AS a FROM {customer}),
e AS (SELECT id, i, trim(a[i]) AS address FROM c, range(1, 9) r(i)),
u AS (SELECT id, arg_min(address, i) AS address, min(i) AS i FROM e WHERE contains(address, '@') GROUP BY id, lower(address))
SELECT id AS contact_id, position, address FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS position, address FROM u) x WHERE position < 4""")
def candidate_addresses(v):
    key = F.col("c_custkey").cast("string")
    guesses = F.array(F.concat(F.lit("ann@b"), key, F.lit(".ORG")), F.lit("junk"), F.lit("info@b.org"), F.concat(F.lit("p"), key, F.lit("@b.org")),
                      F.lit("INFO@b.org"), F.lit("last@b.org"), F.lit(""))
    contacts = v.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" Ann@B"), key, F.lit(".org "))).alias("email"),
        F.transform(guesses, lambda g: F.struct(g.alias("email"))).alias("candidate_emails"))
    return verify.candidate_addresses(contacts, 4)


@query("undecided_addresses", "F10 U5", """
SELECT p.id FROM {v_prospects} p WHERE NOT EXISTS (SELECT 1 FROM {v_prospects} d WHERE d.contact_id = p.contact_id AND d.email = p.email
 AND d.email_status IN ('deliverable', 'undeliverable', 'risky'))""")
def undecided_addresses(v):
    candidates = v.v_prospects.select("id", "contact_id", F.col("email").alias("address"))
    return verify.undecided(candidates, v.v_prospects).select("id")


@query("reserved_domains", "F28", """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS reserved FROM {customer}""")
def reserved_domains(v):
    kind, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    host = (F.when(kind == 0, F.concat(F.lit("Mail"), key, F.lit(".Example.com."))).when(kind == 1, "example.net")
            .when(kind == 2, F.concat(F.lit("myexample.com.b"), key)).when(kind == 3, F.concat(F.lit("b"), key, F.lit(".TEST")))
            .when(kind == 4, "localhost").otherwise(F.concat(F.lit("b"), key, F.lit(".org"))))
    return v.customer.select(F.col("c_custkey").alias("id"), verify.reserved_domain(host).alias("reserved"))
