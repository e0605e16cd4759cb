"""Outreach queries: the ready set, assignment, templates."""

from pyspark.sql import functions as F

from leadloom.functions import templates
from leadloom.operators import outreach
from leadloom.plans.registry import query
from leadloom.plans.reporting import IS_READY, READY


@query("ready_flags", "F4 F5", f"""
SELECT id, {IS_READY} AS ready, ((email_status = 'deliverable' OR approved_by_person) AND outreach_status = 'ready' AND NOT do_not_contact) AS ready_property,
 ((email_status = 'deliverable' OR approved_by_person) AND outreach_status IN ('ready', 'contacted') AND NOT do_not_contact
  AND sequence_stopped_at IS NULL) AS ready_for_follow_up FROM {{v_prospects}}""")
def ready_flags(v):
    return v.v_prospects.select("id", outreach.is_ready().alias("ready"), outreach.is_ready(False).alias("ready_property"),
                                outreach.prospect_ready(F.lit(2)).alias("ready_for_follow_up"))


@query("ready_prospects", "J3 W3", f"SELECT id, contact_id, email FROM ({READY}) r")
def ready_prospects(v):
    return outreach.ready_prospects(v.v_prospects, v.v_emails).select("id", "contact_id", "email")


# Before anything was sent: only the emails still waiting exist.
_UNWRITTEN = "SELECT * FROM {v_emails} WHERE sent_at IS NULL"


@query("writing_queue", "J4 F22", f"""
WITH mail AS ({_UNWRITTEN}), ready AS ({READY.replace('{v_emails_of}', '(SELECT m.*, q.contact_id FROM mail m JOIN {v_prospects} q ON q.id = m.prospect_id)').replace('{v_emails}', 'mail')})
SELECT r.id, e.id AS email_id, e.status AS current_email_status FROM ready r LEFT JOIN mail e ON e.prospect_id = r.id AND e.sequence_step = 1
WHERE e.id IS NULL OR e.status IN ('in_review', 'rejected')""")
def writing_queue(v):
    return outreach.writing_queue(v.v_prospects, v.sql(_UNWRITTEN), regenerate=True).select("id", "email_id", "current_email_status")


@query("prospect_facts", "F22 J5", """
SELECT p.id AS prospect_id, p.business_id, p.contact_id, p.qualification_score, p.email_sequence_id, p.email AS recipient,
 e.id AS email_id, e.status AS current_email_status, b.discovery_campaign_id AS campaign_id, b.name AS business_name, b.category,
 b.city, b.website_url, b.google_rating, b.google_review_count, c.name AS contact_name, c.job_title, g.name AS campaign_name
FROM {v_prospects} p JOIN {v_businesses} b ON b.id = p.business_id JOIN {v_contacts} c ON c.id = p.contact_id
JOIN {v_campaigns} g ON g.id = b.discovery_campaign_id
LEFT JOIN {v_emails} e ON e.prospect_id = p.id AND e.sequence_step = 1""")
def prospect_facts(v):
    return outreach.prospect_facts(v.v_prospects, v.v_businesses, v.v_contacts, v.v_campaigns, v.v_emails)


@query("balanced_assignment", "W7 J18", """
WITH p AS (SELECT q.id, b.discovery_campaign_id AS campaign_id, q.email_sequence_id, q.qualification_score
           FROM {v_prospects} q JOIN {v_businesses} b ON b.id = q.business_id),
new AS (SELECT id, campaign_id, row_number() OVER (PARTITION BY campaign_id ORDER BY qualification_score DESC NULLS LAST, id) AS n
        FROM p WHERE email_sequence_id IS NULL),
sizes AS (SELECT c.campaign_id, c.sequence_id, count(p.id) AS size FROM {v_campaign_sequences} c
          LEFT JOIN p ON p.campaign_id = c.campaign_id AND p.email_sequence_id = c.sequence_id GROUP BY 1, 2),
slots AS (SELECT campaign_id, sequence_id, row_number() OVER (PARTITION BY campaign_id ORDER BY size + k, sequence_id) AS n
          FROM sizes CROSS JOIN range(0, (SELECT max(n) FROM new)) r(k))
SELECT new.id, new.campaign_id, slots.sequence_id FROM new JOIN slots USING (campaign_id, n)""")
def balanced_assignment(v):
    campaign = v.v_businesses.select(F.col("id").alias("business_id"), F.col("discovery_campaign_id").alias("campaign_id"))
    people = v.v_prospects.join(campaign, "business_id")
    return outreach.balanced_assignment(people, people.where(F.col("email_sequence_id").isNull()), v.v_campaign_sequences)


@query("resolved_templates", "J17", """
SELECT p.id, p.id % 6 AS sequence, CASE WHEN p.id % 6 = 0 THEN s.initial_template_id ELSE f.template_id END AS template_id,
 CASE WHEN (CASE WHEN p.id % 6 = 0 THEN s.initial_template_id ELSE f.template_id END) IS NULL THEN
  CASE WHEN s.id IS NULL THEN 'its campaign has no email sequence (choose one on the campaign)'
   WHEN p.id % 6 = 0 THEN 'its sequence ' || s.name || ' has no initial-email template'
   WHEN f.sequence IS NULL THEN 'its sequence ' || s.name || ' has no follow-up ' || (p.id % 6)
   ELSE 'follow-up ' || (p.id % 6) || ' of its sequence ' || s.name || ' has no template' END END AS reason
FROM {v_prospects} p LEFT JOIN {v_sequences} s ON s.id = p.email_sequence_id
LEFT JOIN {v_follow_ups} f ON f.sequence_id = p.email_sequence_id AND f.sequence = p.id % 6""")
def resolved_templates(v):
    rows = v.v_prospects.select("id", "email_sequence_id", (F.col("id") % 6).cast("int").alias("sequence"))
    return outreach.resolve_template(rows, v.v_sequences, v.v_follow_ups).drop("email_sequence_id")


SUBJECT = "Quick question for {{business_short_name}}, {{first_name|there}}"
BODY = ("{{greeting}}\n\nYour {{category}} in {{city}} has {{google_rating|no}} stars from {{google_review_count|no}} reviews. "
        "{{ team_size |a few }} people, {{languages}}.\n\nAs {{job_title|the owner}}, is {{website}} yours?\n\n{{sender_name}}")
_FACTS = """
SELECT b.id, b.name || CASE id % 5 WHEN 0 THEN ' — Branch' WHEN 1 THEN ' | DHA' WHEN 2 THEN ' - North Side' WHEN 3 THEN ' (Main)' ELSE ' - a b c d' END AS business_name,
 b.category, b.city, b.website_url, b.google_rating, b.google_review_count,
 CASE id % 4 WHEN 0 THEN 'Dr. Ann Lee' WHEN 1 THEN 'x@y.org' WHEN 2 THEN NULL ELSE 'Mr.Bo Chan' END AS contact_name,
 CASE id % 3 WHEN 0 THEN 'Owner (practice named after them)' WHEN 1 THEN NULL ELSE '(guess)' END AS job_title,
 CASE WHEN id % 6 = 0 THEN NULL ELSE cast(id % 9 AS string) END AS team_size
FROM {v_businesses} AS b"""


@query("template_fill", "X25 X26 X12", f"""
WITH f AS (SELECT *, regexp_replace(split_part(split_part(split_part(split_part(business_name, ' — ', 1), ' – ', 1), ' | ', 1), ' (', 1), ' - North Side$', '') AS short,
  CASE id % 4 WHEN 0 THEN 'Ann' WHEN 3 THEN 'Bo' END AS first, CASE WHEN id % 3 = 0 THEN 'Owner' END AS title FROM ({_FACTS}) x),
g AS (SELECT *, nullif(list_filter(['city', 'website'], lambda m: CASE WHEN m = 'city' THEN coalesce(city, '') = '' ELSE coalesce(website_url, '') = '' END), []) AS missing FROM f)
SELECT id, array_to_string(missing, ',') AS missing,
 CASE WHEN missing IS NULL THEN 'Quick question for ' || short || ', ' || coalesce(first, 'there') END AS subject,
 CASE WHEN missing IS NULL THEN CASE WHEN first IS NULL THEN 'Hi' ELSE 'Hi ' || first || ',' END || chr(10) || chr(10) || 'Your ' || category || ' in ' || city
  || ' has ' || coalesce(regexp_replace(cast(google_rating AS varchar), '\\.0$', ''), 'no') || ' stars from ' || coalesce(cast(google_review_count AS varchar), 'no') || ' reviews. '
  || coalesce(team_size, 'a few') || ' people, English, Urdu.' || chr(10) || chr(10) || 'As ' || coalesce(title, 'the owner') || ', is ' || website_url || ' yours?'
  || chr(10) || chr(10) || 'The team' END AS body FROM g""")
def template_fill(v):
    rows = v.sql(_FACTS).withColumn("extracted", F.create_map(
        F.lit("team_size"), F.col("team_size"), F.lit("languages"), F.lit("English, Urdu")))
    values = templates.variables(sender_name="The team", sender_company="Us", extracted="extracted")
    return rows.withColumn("values", values).withColumn("draft", templates.render(SUBJECT, BODY, "values")).select(
        "id", F.when(F.size("draft.missing") > 0, F.array_join("draft.missing", ",")).alias("missing"),
        F.col("draft.subject").alias("subject"), F.col("draft.body").alias("body"))


# braces would name tables here, so variables stand in << >>
_TEMPLATES = """SELECT * FROM (VALUES (cast(1 AS bigint), 'Hello << business_name >>', 'Dear <<first_name|friend>>,<<nothing|>> is <<city>> home?'),
 (2, '<<city|Your town>> and <<category>>', 'Rated <<google_rating|n/a>> by <<google_review_count|nobody>>.  '), (11, 'Again', '<<greeting>> <<website>>'),
 (12, 'Re <<campaign_name|us>>', 'x'), (13, 'Third << city >>', '<<job_title|you>><<city>>'), (14, '', 'no subject'), (21, 'Two one', 'b <<business_name>>')) t(id, subject, body)"""
_CHOSEN = f"SELECT f.*, cast(1 + id % 4 AS bigint) AS email_sequence_id, cast(id % 5 AS int) AS sequence FROM ({_FACTS}) f"


@query("row_templates", "J4 X26 X25", f"""
WITH c AS (SELECT c.*, CASE WHEN c.sequence = 0 THEN s.initial_template_id ELSE f.template_id END AS template_id FROM ({_CHOSEN}) c
  LEFT JOIN {{v_sequences}} s ON s.id = c.email_sequence_id LEFT JOIN {{v_follow_ups}} f ON f.sequence_id = c.email_sequence_id AND f.sequence = c.sequence),
g AS (SELECT *, CASE id % 4 WHEN 0 THEN 'Ann' WHEN 3 THEN 'Bo' END AS first, nullif(city, '') AS town, CASE WHEN id % 3 = 0 THEN 'Owner' END AS title,
  nullif(website_url, '') AS site, regexp_replace(cast(google_rating AS varchar), '\\.0$', '') AS stars FROM c),
t AS (SELECT *, CASE template_id WHEN 1 THEN CASE WHEN town IS NULL THEN 'city' END WHEN 11 THEN CASE WHEN site IS NULL THEN 'website' END
    WHEN 13 THEN CASE WHEN town IS NULL THEN 'city' END WHEN 14 THEN 'subject' END AS missing FROM g)
SELECT id, template_id, missing,
 CASE WHEN missing IS NULL THEN CASE template_id WHEN 1 THEN 'Hello ' || business_name WHEN 2 THEN coalesce(town, 'Your town') || ' and ' || category
   WHEN 11 THEN 'Again' WHEN 12 THEN 'Re us' WHEN 13 THEN 'Third ' || town WHEN 21 THEN 'Two one' END END AS subject,
 CASE WHEN missing IS NULL THEN CASE template_id WHEN 1 THEN 'Dear ' || coalesce(first, 'friend') || ', is ' || town || ' home?'
   WHEN 2 THEN 'Rated ' || coalesce(stars, 'n/a') || ' by ' || coalesce(cast(google_review_count AS varchar), 'nobody') || '.'
   WHEN 11 THEN CASE WHEN first IS NULL THEN 'Hi' ELSE 'Hi ' || first || ',' END || ' ' || site WHEN 12 THEN 'x' WHEN 13 THEN coalesce(title, 'you') || town
   WHEN 21 THEN 'b ' || business_name END END AS body FROM t""")
def row_templates(v):
    """From prospect facts through the template each row resolves to, to its text."""
    resolved = outreach.resolve_template(v.sql(_CHOSEN), v.v_sequences, v.v_follow_ups)
    rows = resolved.withColumn("values", templates.variables(sender_name="The team", sender_company="Us"))
    braces = {c: F.replace(F.replace(F.col(c), F.lit("<<"), F.lit("{{")), F.lit(">>"), F.lit("}}")) for c in ("subject", "body")}
    drafted = templates.render_rows(rows, v.sql(_TEMPLATES).withColumns(braces), "values")
    return drafted.select("id", "template_id", F.when(F.size("draft.missing") > 0, F.array_join("draft.missing", ",")).alias("missing"),
                          F.col("draft.subject").alias("subject"), F.col("draft.body").alias("body"))


@query("template_problems", "X27", """
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Dear {{first_name}} ' WHEN 1 THEN '{{nobody|x}} and {{ city }} ' WHEN 2 THEN '{{previous_subject}} '
   WHEN 3 THEN '{{City}} is {{broken ' ELSE 'plain ' END || text AS text FROM {documents})
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'unknown variable nobody' WHEN 2 THEN 'previous_subject only exists in follow-ups'
   WHEN 3 THEN 'broken variable {{City}}' ELSE '' END AS problems,
  CASE doc_id % 5 WHEN 0 THEN 'first_name' WHEN 1 THEN 'nobody,city' WHEN 2 THEN 'previous_subject' ELSE '' END AS used FROM t""")
def template_problems(v):
    kind = F.col("doc_id") % 5
    text = F.concat(F.when(kind == 0, "Dear {{first_name}} ").when(kind == 1, "{{nobody|x}} and {{ city }} ")
                    .when(kind == 2, "{{previous_subject}} ").when(kind == 3, "{{City}} is {{broken ").otherwise("plain "), F.col("text"))
    rows = v.documents.select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.array_join(templates.problems("text", ["first_name", "city", "previous_subject"], follow_up=False), "; ").alias("problems"),
                       F.array_join(templates.used_variables("text"), ",").alias("used"))


@query("rendered_emails", "X28", """
WITH d AS (SELECT doc_id, trim(text, ' \t\n\r') AS body FROM {documents})
SELECT doc_id, body || chr(10) || chr(10) || '--' || chr(10) || 'Us & Co' AS body_text, body AS editable,
 len(list_filter(string_split_regex(body, '\\n\\s*\\n'), lambda p: trim(p, ' \t\n\r') <> '')) AS paragraphs FROM d""")
def rendered_emails(v):
    text = templates.render_text(F.col("text"), "Us & Co")
    html = templates.render_html(F.col("text"), "Us & Co")
    rows = v.documents.select("doc_id", text.alias("body_text"), html.alias("html"))
    paragraphs = F.size(F.split("html", "<p>")) - 1
    return rows.select("doc_id", "body_text", templates.editable_body(F.col("body_text")).alias("editable"),
                       paragraphs.cast("int").alias("paragraphs"))


@query("tracking_urls", "X29", """
SELECT id, 43 AS n, true AS valid FROM {v_emails}""")
def tracking_urls(v):
    token = templates.tracking_token(F.col("id"), "salt")
    return v.v_emails.select("id", F.length(token).alias("n"), templates.tracking_url(F.lit("https://t.example.org/footer"), token)
                             .rlike("^https://t\\.example\\.org/footer/[A-Za-z0-9_-]{32,128}$").alias("valid"))
