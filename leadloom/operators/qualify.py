"""Which businesses go on: qualification predicates, work queues and list segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABANDONED_AFTER = "INTERVAL 10 MINUTES"  # a research takes a few minutes


def with_profile(businesses: DataFrame, profiles: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Businesses with their (optional) profile and their campaign's minimum score."""
    profile = profiles.select(
        "business_id", F.lit(True).alias("has_profile"), F.col("status").alias("profile_status"),
        "qualification_score", "contact_discovery_status", F.col("updated_at").alias("profile_updated_at"))
    minimum = campaigns.select(F.col("id").alias("discovery_campaign_id"), "min_score",
                               F.col("prompt").alias("campaign_prompt"))
    return (businesses.join(profile, businesses.id == profile.business_id, "left").drop("business_id")
            .join(minimum, "discovery_campaign_id")
            .withColumn("has_profile", F.coalesce("has_profile", F.lit(False))))


def _researched() -> Column:
    return F.col("profile_status") == "completed"


def is_qualified(min_score: int | None = None) -> Column:
    """Scored at least the minimum and not rejected, or approved by a person (NULL decision = not rejected)."""
    minimum = F.col("min_score") if min_score is None else F.lit(min_score)
    scored = _researched() & (F.col("qualification_score") >= minimum)
    undecided = F.coalesce("review_status", F.lit("")) != "rejected"
    return F.coalesce((scored & undecided) | (F.col("review_status") == "approved"), F.lit(False))


def has_website() -> Column:
    return F.coalesce("website_url", F.lit("")) != ""


def needs_review() -> Column:
    """No decision yet, and below the minimum, failed, or without a website to research."""
    below = _researched() & (F.col("qualification_score") < F.col("min_score"))
    failed = F.col("profile_status") == "failed"
    no_site = ~has_website() & (~F.col("has_profile") | F.col("profile_status").isin("pending", "failed"))
    waits = F.coalesce(below, F.lit(False)) | F.coalesce(failed, F.lit(False)) | F.coalesce(no_site, F.lit(False))
    return F.col("review_status").isNull() & waits


def qualification_label() -> Column:
    scored = _researched() & F.col("qualification_score").isNotNull()
    return (F.when(F.col("review_status") == "approved", "Approved by a person")
            .when(F.col("review_status") == "rejected", "Rejected by a person")
            .when(scored & (F.col("qualification_score") >= F.col("min_score")), "Qualified")
            .when(scored, F.concat(F.lit("Below "), F.col("min_score").cast("string"), F.lit(": review")))
            .when((F.col("profile_status") == "failed") | ~has_website(), "Not researchable: review")
            .otherwise("-"))


def research_queue(joined: DataFrame, now: dt.datetime, *, retry_failed: bool = False, redo: bool = False,
                   limit: int | None = None) -> DataFrame:
    """Businesses with a site to research; a research left running too long counts as abandoned."""
    live = F.coalesce((F.col("profile_status") == "running")
                      & ~(F.col("profile_updated_at") < F.lit(now) - F.expr(ABANDONED_AFTER)), F.lit(False))
    abandoned = (F.col("profile_status") == "running") & ~live
    if redo:
        due = ~live
    else:
        again = ("pending", "failed") if retry_failed else ("pending",)
        due = ~F.col("has_profile") | F.col("profile_status").isin(*again) | abandoned
    queue = joined.where(has_website() & due)
    return queue if limit is None else queue.orderBy("id").limit(limit)


def prompted(queue: DataFrame, has_prompt: bool = True) -> DataFrame:
    """The part of a research queue whose campaign has (or lacks) a prompt."""
    blank = F.trim(F.coalesce("campaign_prompt", F.lit(""))) == ""
    return queue.where(~blank if has_prompt else blank)


def discovery_queue(joined: DataFrame, *, min_score: int | None = None, redo: bool = False,
                    limit: int | None = None) -> DataFrame:
    """Qualified, named businesses whose decision makers were not searched yet, best score first."""
    queue = joined.where(is_qualified(min_score) & F.col("name").isNotNull())
    if not redo:
        queue = queue.where(~F.col("has_profile") | F.col("contact_discovery_status").isNull())
    queue = queue.orderBy(F.desc_nulls_last("qualification_score"), "id")
    return queue if limit is None else queue.limit(limit)


def missing_details() -> Column:
    blank = [F.coalesce(F.col(name), F.lit("")) == "" for name in ("category", "city")]
    return blank[0] | F.col("google_review_count").isNull() | blank[1]


def limited_view() -> Column:
    """A rating served without its review count."""
    return F.col("google_rating").isNotNull() & F.col("google_review_count").isNull()


def setup_problems(campaigns: DataFrame, campaign_sequences: DataFrame, sequences: DataFrame,
                   follow_ups: DataFrame) -> DataFrame:
    """What each campaign lacks: (campaign_id, problem, sequence_id, step)."""
    null_id, null_step = F.lit(None).cast("long"), F.lit(None).cast("int")
    campaign = campaigns.select(F.col("id").alias("campaign_id"), "prompt")
    no_prompt = campaign.where(F.col("prompt").isNull()).select(
        "campaign_id", F.lit("no prompt").alias("problem"), null_id.alias("sequence_id"), null_step.alias("step"))
    bare = campaign.join(campaign_sequences, "campaign_id", "left_anti").select(
        "campaign_id", F.lit("no sequence").alias("problem"), null_id.alias("sequence_id"), null_step.alias("step"))
    used = campaign.select("campaign_id").join(campaign_sequences, "campaign_id")
    no_initial = used.join(sequences.where(F.col("initial_template_id").isNull())
                           .select(F.col("id").alias("sequence_id")), "sequence_id").select(
        "campaign_id", F.lit("no initial template").alias("problem"), "sequence_id", null_step.alias("step"))
    no_step = used.join(follow_ups.where(F.col("template_id").isNull())
                        .select("sequence_id", F.col("sequence").alias("step")), "sequence_id").select(
        "campaign_id", F.lit("no step template").alias("problem"), "sequence_id", "step")
    return no_prompt.unionByName(bare).unionByName(no_initial).unionByName(no_step)


# ---------------------------------------------------------------- list segments


def score_bucket() -> Column:
    score = F.col("qualification_score")
    return F.when(score >= 80, "80").when(score >= 50, "50").when(score < 50, "low").otherwise("none")


def rating_bucket() -> Column:
    rating = F.col("google_rating")
    return F.when(rating >= 4.5, "45").when(rating >= 4.0, "40").when(rating < 4.0, "low").otherwise("none")


def reviews_bucket() -> Column:
    """The lists a business is in by its reviews; one with a known count of zero is in "few" and in "none"."""
    count = F.col("google_review_count")
    return F.when(count.isNull(), "none").when(count == 0, "few,none").when(count >= 100, "100").when(count >= 20, "20").otherwise("few")


def research_bucket() -> Column:
    status = F.col("profile_status")
    return F.when(status.isNull() | (status == "pending"), "none").otherwise(status)


def discovery_bucket() -> Column:
    return (F.when(F.col("contact_discovery_status") == "completed", "found")
            .when(F.col("contact_discovery_status") == "no_contacts", "none").otherwise("todo"))


def children(contacts: DataFrame, prospects: DataFrame, emails: DataFrame) -> DataFrame:
    """One row per business: how many children it has and which kinds, each child table aggregated on its own.

    Counting after joining contacts, prospects and emails to the business would multiply them.
    """
    ready = (F.col("outreach_status") == "ready") & ~F.col("do_not_contact")
    per_contact = contacts.groupBy("business_id").agg(F.count("*").alias("contact_total"))
    per_prospect = prospects.groupBy("business_id").agg(
        F.count("*").alias("prospect_total"), F.bool_or(ready).alias("has_ready"),
        F.bool_or(F.col("outreach_status") == "needs_review").alias("has_prospect_review"),
        F.bool_or(F.col("outreach_status") == "contacted").alias("has_contacted"))
    per_email = emails.groupBy("business_id").agg(
        F.count("*").alias("email_total"),
        *[F.bool_or(F.col("status") == s).alias(f"email_{s}") for s in ("in_review", "approved", "replied")],
        F.bool_or(F.col("status").isin("sent", "opened")).alias("email_sent"))
    joined = per_contact.join(per_prospect, "business_id", "full").join(per_email, "business_id", "full")
    flags = [c for c, t in joined.dtypes if t == "boolean"]
    totals = [c for c in joined.columns if c.endswith("_total")]
    return joined.select("business_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in totals],
                         *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def with_children(businesses: DataFrame, child: DataFrame) -> DataFrame:
    joined = businesses.join(child, businesses.id == child.business_id, "left").drop("business_id")
    kinds = dict(child.dtypes)
    return joined.withColumns({c: F.coalesce(c, F.lit(0) if kinds[c] == "bigint" else F.lit(False))
                               for c in child.columns if c != "business_id"})


def segments(df: DataFrame) -> DataFrame:
    """Every list segment of a business (see with_profile, with_children) as columns."""
    return df.select(
        "id", score_bucket().alias("score"), rating_bucket().alias("rating"), reviews_bucket().alias("reviews"),
        research_bucket().alias("research"), discovery_bucket().alias("discovery"),
        F.when(has_website(), "yes").otherwise("no").alias("website"),
        F.when(F.col("contact_total") > 0, "yes").otherwise("no").alias("contacts"),
        F.when(F.col("email_replied"), "yes").otherwise("no").alias("replied"),
        F.concat_ws(",", F.when(F.col("has_ready"), F.lit("ready")), F.when(F.col("has_prospect_review"), F.lit("review")),
                    F.when(F.col("has_contacted"), F.lit("contacted")),
                    F.when(F.col("prospect_total") == 0, F.lit("none"))).alias("prospects"),
        F.concat_ws(",", F.when(F.col("email_in_review"), F.lit("review")),
                    F.when(F.col("email_approved"), F.lit("approved")),
                    F.when(F.col("email_sent"), F.lit("sent")), F.when(~F.col("email_sent"), F.lit("unsent")),
                    F.when(F.col("email_total") == 0, F.lit("none"))).alias("emails"))


QUICK_FILTERS = (
    ("All businesses", lambda: F.lit(True)),
    ("Not researched", lambda: research_bucket() == "none"),
    ("Needs your review", needs_review),
    ("Qualified", is_qualified),
    ("Score 80+", lambda: F.col("qualification_score") >= 80),
    ("100+ reviews", lambda: F.col("google_review_count") >= 100),
    ("Rated 4.5+", lambda: F.col("google_rating") >= 4.5),
    ("No contacts yet", lambda: F.col("contact_total") == 0),
    ("Ready to email", lambda: F.col("has_ready")),
    ("Email sent", lambda: F.col("email_sent")),
)


def quick_filter_counts(df: DataFrame) -> DataFrame:
    """All quick filters counted in one pass: (position, label, n)."""
    counts = df.agg(*[F.count_if(test()).alias(f"n{i}") for i, (_, test) in enumerate(QUICK_FILTERS)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(f"n{i}").alias("n"))
                     for i, (label, _) in enumerate(QUICK_FILTERS)])
    return counts.select(F.inline(rows))


def decide(businesses: DataFrame, ids: DataFrame, decision: str) -> DataFrame:
    """A person's decision on the businesses named in ``ids`` (id)."""
    if decision not in ("approved", "rejected"):
        raise ValueError("decision must be approved or rejected")
    chosen = ids.select("id").distinct().withColumn("__chosen", F.lit(True))
    return (businesses.join(chosen, "id", "left")
            .withColumn("review_status", F.when(F.col("__chosen"), decision).otherwise(F.col("review_status")))
            .drop("__chosen"))


def without_sent(businesses: DataFrame, emails: DataFrame) -> DataFrame:
    sent = emails.where(F.col("status").isin("sent", "opened")).select(F.col("business_id").alias("id"))
    return businesses.join(sent, "id", "left_anti")
