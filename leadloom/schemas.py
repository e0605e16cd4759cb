"""Table schemas, enumerations in display order, and the settings row as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Enumerations, in display order.
PIPELINE_STAGES = (
    ("new_lead", "New Lead"), ("ready_to_send", "Ready to Send"), ("initial_email", "Initial Email"),
    ("follow_up", "Follow-up"), ("replied", "Replied"), ("demo_booked", "Demo Booked"), ("demo_done", "Demo Done"),
    ("won", "Won"), ("lost", "Lost"), ("quota_exhausted", "Quota Exhausted"),
)
SENDING_STAGES = ("new_lead", "ready_to_send", "initial_email", "follow_up")
STOP_STAGES = ("replied", "demo_booked", "demo_done", "won", "lost", "quota_exhausted")
RESUME_STAGES = ("initial_email", "follow_up")
EMAIL_STATUSES = ("in_review", "approved", "queued", "sending", "failed", "rejected", "sent", "opened", "replied")
SENT = ("sent", "opened")
NOT_SENT = ("in_review", "approved", "queued", "failed")
EDITABLE = ("in_review", "approved", "queued", "rejected", "failed")
HOLDS_SLOT = ("approved", "queued", "sending", "sent", "opened", "replied")
REFILLABLE = ("in_review", "rejected")
VERDICTS = ("deliverable", "catch_all", "full_inbox", "disposable", "risky", "mailbox_not_found", "disabled",
            "no_mail_server", "invalid_syntax", "smtp_unreachable", "blocked", "temporary_failure", "check_failed",
            "webmail", "excluded", "unknown")
MANAGED_OUTREACH = ("pending", "ready", "needs_review", "rejected")
CONCLUSIVE = ("deliverable", "undeliverable", "risky")
OWN_CONTACT_SOURCES = ("website", "search", "inferred", "pattern", "hunter")
USAGE_ACTIONS = ("research", "email_scoring", "decision_makers", "verification", "other")
PROFILE_STATUSES = ("pending", "running", "completed", "failed")

# Generic addresses that are never emailed, in list order.
DEFAULT_EXCLUDED_PATTERNS = (
    "info@*", "business@*", "contact@*", "contactus@*", "hello@*", "hi@*", "office@*", "admin@*", "support@*",
    "help@*", "sales@*", "marketing@*", "reception@*", "frontdesk@*", "appointments@*", "appointment@*", "booking@*",
    "bookings@*", "enquiries@*", "enquiry@*", "inquiries@*", "inquiry@*", "care@*", "customercare@*", "feedback@*",
    "careers@*", "jobs@*", "hr@*", "billing@*", "accounts@*", "noreply@*", "no-reply@*", "donotreply@*",
    "webmaster@*",
)


@dataclass(frozen=True)
class Settings:
    """The one settings row, passed to operators as plain parameters."""

    daily_cap: int = 40
    gap_fixed_seconds: int = 120
    gap_random_min_seconds: int = 180
    gap_random_max_seconds: int = 300
    reply_window_days: int = 3
    email_scoring_enabled: bool = True
    email_min_score: int = 60
    excluded_patterns: tuple[str, ...] = field(default=DEFAULT_EXCLUDED_PATTERNS)
    footer_text: str = "If you would rather not hear from us, reply with \"unsubscribe\"."

    def __post_init__(self):
        if self.daily_cap < 1:
            raise ValueError("daily_cap must be at least 1")
        if self.gap_random_min_seconds > self.gap_random_max_seconds:
            raise ValueError("the smallest random gap exceeds the largest")
        if not 0 <= self.email_min_score <= 100:
            raise ValueError("email_min_score must be between 0 and 100")


def _ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


LINK = "struct<url:string,text:string,same_site:boolean>"
PAGE = (f"struct<url:string,content:string,links:array<{LINK}>,emails:array<string>,summary:string,"
        "relevant_findings:array<string>,agent_action:string,requested_next_url:string,request_reason:string>")

# DDL per table; schema(name) parses one.
TABLE_DDL = {
    "campaigns": "id bigint, name string, target_country string, target_locations array<string>, search_terms array<string>, "
                 "status string, campaign_prompt_id bigint, min_score int, send_window_start string, send_window_end string, "
                 "send_timezone string, lead_source string, started_at timestamp, completed_at timestamp, "
                 "created_at timestamp, updated_at timestamp",
    "campaign_sequences": "campaign_id bigint, sequence_id bigint",
    "campaign_prompts": "id bigint, name string, prompt string, answer_schema variant, "
                        "output_fields array<struct<name:string,type:string,description:string>>",
    "email_templates": "id bigint, name string, kind string, subject string, body string",
    "email_sequences": "id bigint, name string, initial_template_id bigint",
    "follow_ups": "id bigint, email_sequence_id bigint, sequence int, days_after_previous int, email_prompt_id bigint",
    "mailboxes": "id bigint, name string, from_email string, from_name string, priority int, is_active boolean, "
                 "last_error string, last_used_at timestamp",
    "businesses": "id bigint, discovery_campaign_id bigint, name string, category string, website_url string, domain string, "
                  "phone string, address string, city string, state string, country string, postal_code string, "
                  "latitude decimal(10,7), longitude decimal(10,7), google_place_id string, google_maps_url string, "
                  "google_rating decimal(2,1), google_review_count int, opening_hours array<string>, source string, "
                  "source_url string, first_discovered_at timestamp, last_discovered_at timestamp, replied_at timestamp, "
                  "review_status string",
    "business_sources": "id bigint, business_id bigint, source string, source_business_id string, source_url string, "
                        "raw_data variant, discovered_at timestamp",
    "website_profiles": f"id bigint, business_id bigint, status string, pages_scraped int, scraped_urls array<string>, "
                        f"scraped_pages array<{PAGE}>, discovered_links array<{LINK}>, emails array<string>, "
                        "qualification_score int, qualification_reasons array<string>, agent_reasoning string, team_size int, "
                        "languages array<string>, extracted map<string,string>, contact_discovery_status string, "
                        "contact_discovery_at timestamp, updated_at timestamp",
    "contacts": "id bigint, business_id bigint, name string, first_name string, last_name string, job_title string, "
                "role_type string, email string, email_source string, email_status string, email_checked_at timestamp, "
                "email_check_details variant, candidate_emails array<struct<email:string,pattern:string,"
                "confidence:decimal(4,3),check:string,checked_at:timestamp>>, linkedin_url string, source_urls array<string>, "
                "confidence decimal(4,3), is_primary boolean, discovery_reasoning string",
    "prospects": "id bigint, business_id bigint, contact_id bigint, email string, email_status string, verdict string, "
                 "verification_note string, verification_details variant, email_verification_provider string, "
                 "email_verified_at timestamp, qualification_score int, outreach_status string, outreach_priority string, "
                 "email_sequence_id bigint, email_score int, email_score_reason string, email_scored_at timestamp, "
                 "approved_by_person boolean, pipeline_stage string, stage_changed_at timestamp, sequence_stopped_at timestamp, "
                 "sequence_stop_reason string, outreach_facts array<string>, research_summary string, do_not_contact boolean, "
                 "last_contacted_at timestamp",
    "stage_changes": "id bigint, prospect_id bigint, from_stage string, to_stage string, changed_by string, note string, "
                     "changed_at timestamp",
    "emails": "id bigint, prospect_id bigint, business_id bigint, contact_id bigint, sequence_step int, recipient string, "
              "subject string, body_text string, body_html string, tracking_token string, status string, "
              "generation_provider string, generation_model string, email_prompt_id bigint, generated_at timestamp, "
              "reviewed_at timestamp, review_note string, edited_at timestamp, scheduled_at timestamp, queued_at timestamp, "
              "mailbox_id bigint, sent_at timestamp, sent_from string, message_id string, send_error string, "
              "first_opened_at timestamp, last_opened_at timestamp, open_count int, updated_at timestamp",
    "email_open_events": "id bigint, email_id bigint, opened_at timestamp, user_agent string",
    "usage_records": "id bigint, created_at timestamp, provider string, action string, model string, business_id bigint, "
                     "prospect_id bigint, run_id bigint, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, "
                     "credits decimal(8,2), detail string",
    "pipeline_runs": "id bigint, command string, arguments array<string>, status string, exit_code int, "
                     "created_at timestamp, started_at timestamp, finished_at timestamp",
}


def schema(table: str) -> T.StructType:
    return _ddl(TABLE_DDL[table])


# Output fields a user may ask research to fill: their type names and Spark types.
OUTPUT_FIELD_TYPES = {
    "text": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "yes/no": T.BooleanType(),
    "text list": T.ArrayType(T.StringType()), "integer list": T.ArrayType(T.LongType()),
}
CORE_ANSWER_FIELDS = ("action", "url", "score", "reasons", "reasoning", "reason", "summary", "relevant_findings")
MAX_OUTPUT_FIELDS = 20


def user_fields_schema(fields: list[dict]) -> T.StructType:
    """The struct type of user-defined output fields, for ``from_json``."""
    if len(fields) > MAX_OUTPUT_FIELDS:
        raise ValueError(f"at most {MAX_OUTPUT_FIELDS} output fields")
    names = [f["name"] for f in fields]
    if len(set(names)) != len(names) or set(names) & set(CORE_ANSWER_FIELDS):
        raise ValueError("output field names must be distinct and not one of the answer's own fields")
    return T.StructType([T.StructField(f["name"], OUTPUT_FIELD_TYPES[f["type"]]) for f in fields])
