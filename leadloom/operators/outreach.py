"""Which prospects may be written to, which template they get, and which sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.verify import present
from leadloom.scale import join_summary, positions, with_block
from leadloom.schemas import REFILLABLE


def is_ready(with_stop: bool = True) -> Column:
    """Verified (or approved by a person), ready, not do-not-contact; ``with_stop``: and not stopped."""
    cleared = (F.col("email_status") == "deliverable") | F.col("approved_by_person")
    ready = cleared & (F.col("outreach_status") == "ready") & ~F.col("do_not_contact")
    if with_stop:
        ready = ready & F.col("sequence_stopped_at").isNull()
    return F.coalesce(ready, F.lit(False))


def prospect_ready(step: Column) -> Column:
    """Whether an email of this step may go to its prospect: a follow-up may also go to a contacted one."""
    cleared = (F.col("email_status") == "deliverable") | F.col("approved_by_person")
    status = (F.col("outreach_status") == "ready") | ((step > 1) & (F.col("outreach_status") == "contacted"))
    return F.coalesce(cleared & status & ~F.col("do_not_contact") & F.col("sequence_stopped_at").isNull(), F.lit(False))


def ready_prospects(prospects: DataFrame, emails: DataFrame) -> DataFrame:
    """One address per person and one sequence per address.

    The exclusions only ask "does another row with my contact / my address ...", so each needs one
    summary per contact or address: whether any is do-not-contact, the first ready id, and the
    smallest and largest id of the rows that block (both equal to my id means only I block).
    """
    written = emails.select(F.col("prospect_id").alias("id")).distinct().withColumn("has_email", F.lit(True))
    rows = (prospects.join(written, "id", "left").withColumn("has_email", F.coalesce("has_email", F.lit(False)))
            .withColumn("address", F.lower("email")).withColumn("__ready", is_ready()))
    holds = F.col("pipeline_stage").isNotNull() | F.col("has_email")
    per_contact = rows.groupBy("contact_id").agg(
        F.count(F.lit(1)).alias("contact_rows"), F.bool_or("do_not_contact").alias("contact_dnc"), F.min(F.when(F.col("__ready"), F.col("id"))).alias("contact_first"),
        F.min(F.when(F.col("has_email"), F.col("id"))).alias("writer_min"),
        F.max(F.when(F.col("has_email"), F.col("id"))).alias("writer_max"))
    per_address = rows.groupBy("address").agg(
        F.count(F.lit(1)).alias("address_rows"), F.bool_or("do_not_contact").alias("address_dnc"), F.min(F.when(F.col("__ready"), F.col("id"))).alias("address_first"),
        F.min(F.when(holds, F.col("id"))).alias("holder_min"), F.max(F.when(holds, F.col("id"))).alias("holder_max"))

    def only_me(low: str, high: str) -> Column:
        return F.col(low).isNull() | ((F.col(low) == F.col("id")) & (F.col(high) == F.col("id")))

    known = rows.where(F.col("__ready") & F.col("contact_id").isNotNull() & F.col("address").isNotNull())
    known = join_summary(known, per_contact, ["contact_id"], "contact_rows", how="inner")
    return (join_summary(known, per_address, ["address"], "address_rows", how="inner")
            .where(~F.col("contact_dnc") & (F.col("contact_first") == F.col("id")) & only_me("writer_min", "writer_max")
                   & ~F.col("address_dnc") & (F.col("address_first") == F.col("id")) & only_me("holder_min", "holder_max"))
            .select(*prospects.columns))


def with_step_email(prospects: DataFrame, emails: DataFrame, step: int = 1) -> DataFrame:
    """Prospects with their email of one step; those without stay (the condition belongs to the join)."""
    of_step = emails.where(F.col("sequence_step") == step).select(
        F.col("prospect_id").alias("id"), F.col("id").alias("email_id"), F.col("status").alias("current_email_status"),
        *present(emails, {"tracking_token": "tracking_token"}))
    return prospects.join(of_step, "id", "left")


def writing_queue(prospects: DataFrame, emails: DataFrame, *, regenerate: bool = False,
                  limit: int | None = None) -> DataFrame:
    """Ready prospects that need an initial email, best qualification first."""
    due = F.col("email_id").isNull()
    if regenerate:
        due = due | F.col("current_email_status").isin(*REFILLABLE)
    queue = with_step_email(ready_prospects(prospects, emails), emails).where(due)
    return queue if limit is None else queue.orderBy(F.desc_nulls_last("qualification_score"), "id").limit(limit)


def prospect_facts(prospects: DataFrame, businesses: DataFrame, contacts: DataFrame, campaigns: DataFrame,
                   emails: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """The wide row templates are filled from: the prospect, its business, research, contact, campaign
    and its first email, under the names templates use (columns a table lacks are left out)."""
    same = lambda *columns: {c: c for c in columns}
    business = businesses.select(F.col("id").alias("business_id"), *present(businesses, {
        "discovery_campaign_id": "campaign_id", "name": "business_name",
        **same("category", "city", "country", "website_url", "google_rating", "google_review_count")}))
    contact = contacts.select(F.col("id").alias("contact_id"), *present(contacts, {
        "name": "contact_name", **same("first_name", "last_name", "job_title", "role_type")}))
    research = None if profiles is None else profiles.select("business_id", *present(
        profiles, same("qualification_reasons", "scraped_pages", "extracted")))
    campaign = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    own = present(prospects, {"id": "prospect_id", "email": "recipient", **same(
        "business_id", "contact_id", "qualification_score", "outreach_facts", "research_summary", "email_sequence_id")})
    rows = with_step_email(prospects, emails)
    rows = rows.select(*own, *present(rows, same("email_id", "current_email_status", "tracking_token")))
    rows = rows.join(business, "business_id").join(contact, "contact_id").join(campaign, "campaign_id")
    return rows if research is None else rows.join(research, "business_id", "left")


def balanced_assignment(prospects: DataFrame, new: DataFrame, campaign_sequences: DataFrame) -> DataFrame:
    """Each new prospect gets its campaign's sequence with the fewest prospects so far (lowest id on ties).

    Handing out one at a time fills the emptiest sequences up to the next level and then goes
    round by id, so the n-th new prospect of a campaign lands where water filling puts it: once
    the first ``width`` sequences (by size, id) stand level, they take turns. Each campaign needs
    one small array of (from which n, those sequences by id); no slot table is expanded.

    ``prospects``: campaign_id, email_sequence_id; ``new``: id, campaign_id, qualification_score.
    """
    sizes = prospects.where(F.col("email_sequence_id").isNotNull()).groupBy(
        "campaign_id", F.col("email_sequence_id").alias("sequence_id")).agg(F.count("*").alias("size"))
    offered = campaign_sequences.select("campaign_id", "sequence_id").distinct().join(
        sizes, ["campaign_id", "sequence_id"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    by_size = offered.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("size", "sequence_id"))).alias("q"))

    def phase(width: Column) -> Column:
        active = F.slice("q", 1, width)
        level = F.element_at("q", width)["size"]
        start = width * level - F.aggregate(active, F.lit(0).cast("long"), lambda acc, s: acc + s["size"])
        return F.struct(start.alias("start"), F.array_sort(F.transform(active, lambda s: s["sequence_id"])).alias("turns"))

    phases = by_size.select("campaign_id", F.transform(F.sequence(F.lit(1), F.size("q")), phase).alias("phases"))
    new = with_block(new.select("id", "campaign_id", "qualification_score"), F.col("id"))
    ranked = positions(new, ["campaign_id"],
                       [F.desc_nulls_last("qualification_score"), F.col("id")],
                       [-F.coalesce("qualification_score", F.lit(-1)), F.col("__part")])
    now = F.element_at(F.filter("phases", lambda p: p["start"] <= F.col("position")), -1)
    placed = ranked.join(phases, "campaign_id").withColumn("__phase", now)
    turn = (F.col("position") - F.col("__phase.start")) % F.size("__phase.turns")
    return placed.select("id", "campaign_id", F.get("__phase.turns", turn.cast("int")).alias("sequence_id"))


def resolve_template(rows: DataFrame, sequences: DataFrame, follow_ups: DataFrame, chosen_id: int | None = None) -> DataFrame:
    """Template and, where there is none, the reason. ``rows``: email_sequence_id, sequence (0 = initial)."""
    names = sequences.select(F.col("id").alias("email_sequence_id"), F.col("name").alias("sequence_name"),
                             "initial_template_id")
    steps = follow_ups.select(F.col("sequence_id").alias("email_sequence_id"), "sequence",
                              F.col("template_id").alias("step_template_id"), F.lit(True).alias("has_step"))
    found = rows.join(names, "email_sequence_id", "left").join(steps, ["email_sequence_id", "sequence"], "left")
    own = F.when(F.col("sequence") == 0, F.col("initial_template_id")).otherwise(F.col("step_template_id"))
    template = F.coalesce(F.lit(chosen_id).cast("long"), own)
    name, number = F.col("sequence_name"), F.col("sequence").cast("string")
    reason = (F.when(name.isNull(), "its campaign has no email sequence (choose one on the campaign)")
              .when(F.col("sequence") == 0, F.concat(F.lit("its sequence "), name, F.lit(" has no initial-email template")))
              .when(F.col("has_step").isNull(), F.concat(F.lit("its sequence "), name, F.lit(" has no follow-up "), number))
              .otherwise(F.concat(F.lit("follow-up "), number, F.lit(" of its sequence "), name, F.lit(" has no template"))))
    return (found.withColumn("template_id", template).withColumn("reason", F.when(template.isNull(), reason))
            .select(*rows.columns, "template_id", "reason"))
