"""Qualification queries."""

from pyspark.sql import functions as F

from leadloom.operators import qualify
from leadloom.plans.registry import query
from leadloom.plans.reporting import CHILDREN, JOINED, NEEDS_REVIEW, NOW, QUALIFIED, full, joined


@query("qualified_businesses", "F1", f"SELECT id, name FROM ({JOINED}) j WHERE {QUALIFIED}")
def qualified_businesses(v):
    return joined(v).where(qualify.is_qualified()).select("id", "name")


@query("qualified_at_60", "F1", f"SELECT id FROM ({JOINED}) j WHERE {QUALIFIED.replace('min_score', '60')}")
def qualified_at_60(v):
    return joined(v).where(qualify.is_qualified(60)).select("id")


@query("businesses_needing_review", "F2", f"SELECT id FROM ({JOINED}) j WHERE {NEEDS_REVIEW}")
def businesses_needing_review(v):
    return joined(v).where(qualify.needs_review()).select("id")


@query("qualification_labels", "F3", f"""
SELECT id, CASE WHEN review_status = 'approved' THEN 'Approved by a person' WHEN review_status = 'rejected' THEN 'Rejected by a person'
 WHEN profile_status = 'completed' AND qualification_score >= min_score THEN 'Qualified'
 WHEN profile_status = 'completed' AND qualification_score IS NOT NULL THEN 'Below ' || min_score || ': review'
 WHEN profile_status = 'failed' OR coalesce(website_url, '') = '' THEN 'Not researchable: review' ELSE '-' END AS label FROM ({JOINED}) j""")
def qualification_labels(v):
    return joined(v).select("id", qualify.qualification_label().alias("label"))


@query("business_segments", "F19", f"""
WITH f AS (SELECT * FROM ({JOINED}) j JOIN ({CHILDREN}) k ON k.business_id = j.id)
SELECT id, CASE WHEN qualification_score >= 80 THEN '80' WHEN qualification_score >= 50 THEN '50' WHEN qualification_score < 50 THEN 'low' ELSE 'none' END AS score,
 CASE WHEN google_rating >= 4.5 THEN '45' WHEN google_rating >= 4 THEN '40' WHEN google_rating < 4 THEN 'low' ELSE 'none' END AS rating,
 CASE WHEN google_review_count IS NULL THEN 'none' WHEN google_review_count = 0 THEN 'few,none' WHEN google_review_count >= 100 THEN '100' WHEN google_review_count >= 20 THEN '20' ELSE 'few' END AS reviews,
 CASE WHEN profile_status IS NULL OR profile_status = 'pending' THEN 'none' ELSE profile_status END AS research,
 CASE contact_discovery_status WHEN 'completed' THEN 'found' WHEN 'no_contacts' THEN 'none' ELSE 'todo' END AS discovery,
 CASE WHEN coalesce(website_url, '') <> '' THEN 'yes' ELSE 'no' END AS website,
 CASE WHEN contact_total > 0 THEN 'yes' ELSE 'no' END AS contacts, CASE WHEN email_replied THEN 'yes' ELSE 'no' END AS replied,
 concat_ws(',', CASE WHEN has_ready THEN 'ready' END, CASE WHEN has_prospect_review THEN 'review' END,
   CASE WHEN prospect_total = 0 THEN 'none' END) AS prospects,
 concat_ws(',', CASE WHEN email_in_review THEN 'review' END, CASE WHEN email_approved THEN 'approved' END,
   CASE WHEN email_sent THEN 'sent' ELSE 'unsent' END, CASE WHEN email_total = 0 THEN 'none' END) AS emails FROM f""")
def business_segments(v):
    return qualify.segments(full(v))


@query("businesses_without_sent", "J6", """
SELECT id FROM {v_businesses} b WHERE NOT EXISTS (SELECT 1 FROM {v_emails_of} e WHERE e.business_id = b.id AND e.status IN ('sent', 'opened'))""")
def businesses_without_sent(v):
    return qualify.without_sent(v.v_businesses, v.v_emails_of).select("id")


_LIVE = "(profile_status = 'running' AND profile_updated_at >= timestamp '2024-01-02 11:50:00')"
_QUEUE = f"""SELECT * FROM ({JOINED}) j WHERE coalesce(website_url, '') <> ''
 AND (NOT has_profile OR profile_status IN ('pending', 'failed') OR (profile_status = 'running' AND NOT {_LIVE}))"""


@query("research_queue", "F6 F7 T6", f"""
SELECT id, coalesce(trim(campaign_prompt), '') <> '' AS has_prompt FROM ({_QUEUE}) q""")
def research_queue(v):
    queue = qualify.research_queue(joined(v), NOW, retry_failed=True)
    yes = qualify.prompted(queue).select("id", F.lit(True).alias("has_prompt"))
    return yes.unionByName(qualify.prompted(queue, False).select("id", F.lit(False).alias("has_prompt")))


@query("research_queue_redo", "F6", f"""
SELECT id FROM ({JOINED}) j WHERE coalesce(website_url, '') <> '' AND NOT coalesce({_LIVE}, false)""")
def research_queue_redo(v):
    return qualify.research_queue(joined(v), NOW, redo=True).select("id")


@query("discovery_queue", "F8 O1 O3", f"""
SELECT id, qualification_score FROM ({JOINED}) j WHERE {QUALIFIED} AND name IS NOT NULL
 AND (NOT has_profile OR contact_discovery_status IS NULL) ORDER BY qualification_score DESC NULLS LAST, id LIMIT 100""")
def discovery_queue(v):
    return qualify.discovery_queue(joined(v), limit=100).select("id", "qualification_score")


@query("missing_details", "F14", """
SELECT id, coalesce(category, '') = '' OR google_review_count IS NULL OR coalesce(city, '') = '' AS missing,
 google_rating IS NOT NULL AND google_review_count IS NULL AS limited FROM {v_businesses}""")
def missing_details(v):
    return v.v_businesses.select("id", qualify.missing_details().alias("missing"), qualify.limited_view().alias("limited"))


@query("setup_problems", "F25 J18", """
SELECT id AS campaign_id, 'no prompt' AS problem, NULL AS sequence_id, NULL AS step FROM {v_campaigns} WHERE prompt IS NULL
UNION ALL SELECT id, 'no sequence', NULL, NULL FROM {v_campaigns} WHERE id NOT IN (SELECT campaign_id FROM {v_campaign_sequences})
UNION ALL SELECT campaign_id, 'no initial template', sequence_id, NULL FROM {v_campaign_sequences} c JOIN {v_sequences} s
  ON s.id = c.sequence_id WHERE s.initial_template_id IS NULL
UNION ALL SELECT campaign_id, 'no step template', c.sequence_id, f.sequence FROM {v_campaign_sequences} c JOIN {v_follow_ups} f
  ON f.sequence_id = c.sequence_id WHERE f.template_id IS NULL""")
def setup_problems(v):
    return qualify.setup_problems(v.v_campaigns, v.v_campaign_sequences, v.v_sequences, v.v_follow_ups)


@query("decide_businesses", "M9", f"""
SELECT id, CASE WHEN {NEEDS_REVIEW} THEN 'approved' ELSE review_status END AS review_status FROM ({JOINED}) j""")
def decide_businesses(v):
    chosen = joined(v).where(qualify.needs_review()).select("id")  # a person approves all that wait for a decision
    return qualify.decide(v.v_businesses, chosen, "approved").select("id", "review_status")
