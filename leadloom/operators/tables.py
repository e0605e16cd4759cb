"""Writing rules as DataFrame merges: replace, upsert, cascade, defaults, and constraint reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.verify import decide
from leadloom.schemas import EMAIL_STATUSES, MANAGED_OUTREACH, OWN_CONTACT_SOURCES, REFILLABLE


def replace_owned(existing: DataFrame, new: DataFrame, processed: DataFrame, owned: tuple[str, ...] = OWN_CONTACT_SOURCES) -> DataFrame:
    """Contacts after a discovery run over the businesses in ``processed`` (business_id): found rows of
    those businesses are replaced, rows of any other source (e.g. manual) kept."""
    ours = F.col("email_source").isNull() | F.col("email_source").isin(*owned)
    gone = existing.where(ours).join(processed.select("business_id").distinct(), "business_id", "left_semi")
    kept = existing.join(gone.select("id"), "id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def discovery_status(processed: DataFrame, new: DataFrame) -> DataFrame:
    """What each processed business's profile is stamped with."""
    found = new.select("business_id").distinct().withColumn("__found", F.lit(True))
    return processed.select("business_id").distinct().join(found, "business_id", "left").select(
        "business_id", F.when(F.col("__found"), "completed").otherwise("no_contacts").alias("contact_discovery_status"))


VERIFIED = ("email_status", "verdict", "verification_note", "verification_details", "email_verification_provider", "email_verified_at",
            "qualification_score")


def upsert_prospects(existing: DataFrame, outcomes: DataFrame, min_score: int) -> DataFrame:
    """Merge verification outcomes on (contact_id, email): new rows whole, matched rows only in their
    verification columns, and in outreach_status while it is still managed and not do-not-contact
    (a stored score decides instead of pending)."""
    key = ["contact_id", "email"]
    incoming = outcomes.select(*key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in outcomes.columns if c not in key])
    rows = existing.withColumn("__old", F.lit(True)).join(incoming, key, "full")
    hit, old = F.coalesce("__hit", F.lit(False)), F.coalesce("__old", F.lit(False))
    rescored = F.when((F.col("__new_outreach_status") == "pending") & F.col("email_score").isNotNull(),
                      decide(F.col("__new_email_status"), F.col("email_score"), min_score)).otherwise(F.col("__new_outreach_status"))
    managed = F.col("outreach_status").isin(*MANAGED_OUTREACH) & ~F.col("do_not_contact")

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        if c not in outcomes.columns:
            return F.col(c)
        new = F.col(f"__new_{c}")
        if c == "outreach_status":
            return F.when(hit & ~old, new).when(hit & managed, rescored).otherwise(F.col(c)).alias(c)
        if c in VERIFIED:
            return F.when(hit, new).otherwise(F.col(c)).alias(c)
        return F.when(hit & ~old, new).otherwise(F.col(c)).alias(c)

    return rows.select(*[value(c) for c in existing.columns])


def upsert_drafts(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Insert drafts per (prospect_id, sequence_step), or refill emails in review or rejected (they go
    back to review, keep their id and token); approved, sent and failed ones are never touched."""
    key = ["prospect_id", "sequence_step"]
    content = [c for c in drafts.columns if c not in key]
    incoming = drafts.select(*key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in content])
    rows = existing.withColumn("__old", F.lit(True)).join(incoming, key, "full")
    fresh = F.col("__old").isNull()
    writes = F.col("__hit").isNotNull() & (fresh | F.col("status").isin(*REFILLABLE))

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        if c == "status":
            return F.when(writes, "in_review").otherwise(F.col(c)).alias(c)
        if c in ("reviewed_at", "review_note", "edited_at"):
            return F.when(~F.coalesce(writes, F.lit(False)), F.col(c)).alias(c)
        if c in ("id", "tracking_token") and c in content:
            return F.when(fresh, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(writes, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in content else F.col(c)

    return rows.select(*[value(c) for c in existing.columns])


def merge_candidate_checks(contacts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write check results (contact_id, address, check, status, checked_at; one per address) into the matching
    elements of candidate_emails, ignoring case; the contact's own status only for its own email.

    A contact has few candidates, so the results come as one small map per contact.
    """
    latest = outcomes.groupBy("contact_id", F.lower(F.trim("address")).alias("__a")).agg(
        F.max(F.struct("checked_at", "check", "status")).alias("r"))
    asked = contacts.select(F.col("id").alias("contact_id"), F.explode(F.array_distinct(F.concat(
        F.array(F.lower(F.trim("email"))), F.transform(F.coalesce("candidate_emails", F.array().cast(contacts.schema["candidate_emails"].dataType)),
                                                       lambda c: F.lower(F.trim(c["email"])))))).alias("__a"))
    results = latest.join(asked, ["contact_id", "__a"], "left_semi").groupBy("contact_id").agg(
        F.map_from_entries(F.collect_list(F.struct("__a", "r"))).alias("__results"))
    rows = contacts.join(results, contacts.id == results.contact_id, "left").drop("contact_id")

    def result(address: Column) -> Column:
        return F.element_at("__results", F.lower(F.trim(address)))

    checked = F.transform("candidate_emails", lambda c: c.withField("check", F.coalesce(result(c["email"])["check"], c["check"])).withField(
        "checked_at", F.coalesce(result(c["email"])["checked_at"], c["checked_at"])))
    own = result(F.col("email"))
    return rows.withColumns({"candidate_emails": checked, "email_status": F.coalesce(own["status"], "email_status"),
                             "email_checked_at": F.coalesce(own["checked_at"], "email_checked_at")}).drop("__results")


# child table -> (foreign key, parent table, what happens when the parent goes)
FOREIGN_KEYS = {
    "businesses": [("discovery_campaign_id", "campaigns", "cascade")],
    "business_sources": [("business_id", "businesses", "cascade")],
    "website_profiles": [("business_id", "businesses", "cascade")],
    "contacts": [("business_id", "businesses", "cascade")],
    "prospects": [("business_id", "businesses", "cascade"), ("contact_id", "contacts", "cascade"), ("email_sequence_id", "email_sequences", "null")],
    "emails": [("prospect_id", "prospects", "cascade"), ("business_id", "businesses", "cascade"), ("contact_id", "contacts", "cascade"),
               ("email_prompt_id", "email_templates", "null"), ("mailbox_id", "mailboxes", "null")],
    "email_open_events": [("email_id", "emails", "cascade")],
    "stage_changes": [("prospect_id", "prospects", "cascade")],
    "usage_records": [("business_id", "businesses", "null"), ("prospect_id", "prospects", "null"), ("run_id", "pipeline_runs", "null")],
    "follow_ups": [("email_sequence_id", "email_sequences", "cascade"), ("email_prompt_id", "email_templates", "null")],
    "campaign_sequences": [("campaign_id", "campaigns", "cascade"), ("sequence_id", "email_sequences", "cascade")],
    "email_sequences": [("initial_template_id", "email_templates", "null")],
}


def cascade_delete(tables: dict[str, DataFrame], parent: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting the rows of ``parent`` named in ``ids`` (id): children go or lose the reference.

    Parents come before children in ``FOREIGN_KEYS``'s reference order, so one sweep follows every chain.
    """
    order = ["campaigns", "email_templates", "email_sequences", "mailboxes", "pipeline_runs", "businesses", "campaign_sequences", "follow_ups",
             "business_sources", "website_profiles", "contacts", "prospects", "emails", "stage_changes", "usage_records", "email_open_events"]
    gone = {parent: ids.select("id").distinct()}
    result = {}
    for name in [t for t in order if t in tables]:
        df = tables[name]
        if name == parent:
            df = df.join(gone[parent], "id", "left_anti").select(*df.columns)
        removed = None
        for column, owner, effect in FOREIGN_KEYS.get(name, []):
            if owner not in gone or column not in df.columns:
                continue
            keys = gone[owner].select(F.col("id").alias(column))
            if effect == "cascade":
                if "id" in df.columns:
                    lost = df.join(keys, column, "left_semi").select("id")
                    removed = lost if removed is None else removed.unionByName(lost)
                df = df.join(keys, column, "left_anti").select(*df.columns)
            else:
                marked = df.join(keys.withColumn("__gone", F.lit(True)), column, "left")
                df = marked.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns])
        if removed is not None:
            gone[name] = removed.distinct() if name not in gone else gone[name].unionByName(removed).distinct()
        result[name] = df
    return result


# ---------------------------------------------------------------- constraints and defaults


def checks_of(table: str) -> dict[str, tuple[tuple[str, ...], Column]]:
    """Row rules of a table: name -> (columns, condition of a violation); NULLs pass, as in SQL CHECK."""
    c = F.col
    window = (c("send_window_start").isNull() != c("send_window_end").isNull()) | (c("send_window_start") >= c("send_window_end"))
    return {
        "campaigns": {
            "status": (("status",), ~c("status").isin("pending", "running", "completed", "failed")),
            "lead_source": (("lead_source",), ~c("lead_source").isin("browser", "scraper_api")),
            "min_score": (("min_score",), (c("min_score") > 100) | (c("min_score") < 0)),
            "send_window": (("send_window_start", "send_window_end"), window),
        },
        "email_templates": {"kind": (("kind",), ~c("kind").isin("initial", "follow_up")), "subject_length": (("subject",), F.length("subject") > 200)},
        "follow_ups": {"sequence": (("sequence",), c("sequence") < 1), "days": (("days_after_previous",), c("days_after_previous") < 1)},
        "contacts": {"confidence": (("confidence",), (c("confidence") < 0) | (c("confidence") > 1))},
        "emails": {"status": (("status",), ~c("status").isin(*EMAIL_STATUSES)), "open_count": (("open_count",), c("open_count") < 0)},
        "businesses": {"name_length": (("name",), F.length("name") > 255),
                       "rating": (("google_rating",), (c("google_rating") < 0) | (c("google_rating") > 5))},
        "prospects": {"email_length": (("email",), F.length("email") > 320),
                      "email_score": (("email_score",), (c("email_score") < 0) | (c("email_score") > 100))},
    }.get(table, {})


UNIQUE = {"emails": ["prospect_id", "sequence_step"], "prospects": ["contact_id", "email"], "follow_ups": ["sequence_id", "sequence"],
          "website_profiles": ["business_id"], "businesses": ["google_place_id"], "mailboxes": ["name"], "email_sequences": ["name"]}


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """(table, rule, violations): every row rule in one pass, and the rows beyond the first of a unique key."""
    usable = {name: test for name, (columns, test) in checks_of(table).items() if set(columns) <= set(df.columns)}
    parts = []
    if usable:
        counts = df.agg(*[F.count_if(test).alias(name) for name, test in usable.items()])
        parts.append(counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in usable]))))
    key = UNIQUE.get(table)
    if key and all(k in df.columns for k in key):
        filled = df.where(F.coalesce(F.col(key[0]).cast("string"), F.lit("")) != "")
        repeated = filled.groupBy(*key).agg((F.count("*") - 1).alias("extra"))
        parts.append(repeated.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")).select(
            F.lit("unique " + ", ".join(key)).alias("rule"), "violations"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(F.lit(table).alias("table"), "rule", "violations")


# Column defaults for rows inserted without them ("now" stands for the load time).
DEFAULTS = {
    "campaigns": {"status": "pending", "min_score": 40, "send_timezone": "Asia/Karachi", "lead_source": "browser", "created_at": "now", "updated_at": "now"},
    "businesses": {"created_at": "now", "updated_at": "now"},
    "business_sources": {"discovered_at": "now"},
    "website_profiles": {"status": "pending", "pages_scraped": 0, "created_at": "now", "updated_at": "now"},
    "contacts": {"email_status": "unverified", "is_primary": False, "created_at": "now", "updated_at": "now"},
    "prospects": {"outreach_status": "pending", "do_not_contact": False, "approved_by_person": False, "created_at": "now", "updated_at": "now"},
    "emails": {"sequence_step": 1, "status": "in_review", "open_count": 0, "created_at": "now", "updated_at": "now"},
    "usage_records": {"action": "other", "input_tokens": 0, "output_tokens": 0, "reasoning_tokens": 0, "credits": 0},
}


def apply_defaults(df: DataFrame, table: str, now: dt.datetime) -> DataFrame:
    """NULLs of defaulted columns filled (arrays with empty ones)."""
    filled = {}
    for field in df.schema.fields:
        value = DEFAULTS.get(table, {}).get(field.name)
        if value is not None:
            filled[field.name] = F.coalesce(F.col(field.name), F.lit(now if value == "now" else value).cast(field.dataType))
        elif field.dataType.typeName() == "array" and field.name not in ("languages", "opening_hours"):
            filled[field.name] = F.coalesce(F.col(field.name), F.array().cast(field.dataType))
    return df.withColumns(filled) if filled else df


def touch(before: DataFrame, after: DataFrame, key: str, now: dt.datetime) -> DataFrame:
    """``updated_at`` of the rows a change really changed set to now."""
    compared = [c for c in after.columns if c not in (key, "updated_at")]
    old = before.select(F.col(key), F.xxhash64(*compared).alias("__was"))
    rows = after.join(old, key, "left")
    same = F.xxhash64(*compared).eqNullSafe(F.col("__was"))
    return rows.withColumn("updated_at", F.when(same, F.col("updated_at")).otherwise(F.lit(now))).drop("__was")


# ---------------------------------------------------------------- one-off backfills


def setup_to_sequences(campaigns: DataFrame, initials: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One sequence per initial template of a campaign (one without template when it only has steps),
    named after the campaign (and the template when there are several), names made unique by (2), (3).

    ``campaigns``: id, name; ``initials``: campaign_id, template_id, template_name; ``steps``: campaign_id, sequence, days, template_id.
    Returns sequences (campaign_id, template_id, name) and their copied steps.
    """
    counted = initials.groupBy("campaign_id").agg(F.count("*").alias("n"))
    own = initials.join(counted, "campaign_id").join(campaigns.withColumnRenamed("id", "campaign_id"), "campaign_id")
    bare = steps.select("campaign_id").distinct().join(initials, "campaign_id", "left_anti").join(
        campaigns.withColumnRenamed("id", "campaign_id"), "campaign_id").select(
        "campaign_id", F.lit(None).cast("long").alias("template_id"), F.lit(None).cast("string").alias("template_name"), F.lit(0).cast("long").alias("n"), "name")
    every = own.select("campaign_id", "template_id", "template_name", "n", "name").unionByName(bare)
    base = F.left(F.when(F.col("n") <= 1, F.col("name")).otherwise(F.concat("name", F.lit(" - "), "template_name")), F.lit(190))
    from leadloom.scale import positions, with_block
    numbered = positions(with_block(every.withColumn("base", base), F.col("campaign_id")), ["base"], [F.col("campaign_id"), F.asc_nulls_first("template_name")],
                         [F.col("__part")], "nth")
    named = F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat("base", F.lit(" ("), (F.col("nth") + 1).cast("string"), F.lit(")")))
    sequences = numbered.select("campaign_id", "template_id", named.alias("name"))
    copied = sequences.join(steps.withColumnRenamed("template_id", "step_template_id"), "campaign_id").select("name", "sequence", "days", "step_template_id")
    return sequences, copied


def prompts_to_kinds(prompts: DataFrame) -> DataFrame:
    """Old prompts (id, owner_id, owner, name, sequence, variation, is_default, opened) with their kind, a unique
    name (owner appended to repeats, then the id) and whether they are their group's best: per owner and
    variation for initial ones, per owner and step for follow-ups; default first, then opened, then id."""
    from leadloom.scale import join_summary, top_k
    first = prompts.groupBy("name").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    owned = F.left(F.concat("name", F.lit(" ("), F.coalesce("owner", F.lit("None")), F.lit(")")), F.lit(240))
    rows = join_summary(prompts, first, ["name"], "__n").withColumn("__owned", F.when(F.col("id") != F.col("__first"), owned))
    # a repeat's owner name may itself be taken: by an original of that name seen earlier, or an earlier repeat
    taken = prompts.groupBy(F.col("name").alias("__owned")).agg(F.min("id").alias("__original"))
    earlier = rows.groupBy("__owned").agg(F.min(F.when(F.col("__owned").isNotNull(), F.col("id"))).alias("__repeat"), F.count(F.lit(1)).alias("__n"))
    rows = join_summary(rows, earlier.join(taken, "__owned", "left"), ["__owned"], "__n")
    clash = F.coalesce(F.col("__original") < F.col("id"), F.lit(False)) | F.coalesce(F.col("__repeat") < F.col("id"), F.lit(False))
    unique = F.when(F.col("__owned").isNull(), F.col("name")).when(clash, F.concat("__owned", F.lit(" #"), F.col("id").cast("string"))).otherwise(F.col("__owned"))
    group = F.when(F.col("sequence") == 0, F.concat(F.lit("v"), "variation")).otherwise(F.concat(F.lit("s"), F.col("sequence").cast("string")))
    rows = rows.select("id", "owner_id", "is_default", "opened", unique.alias("unique_name"), group.alias("group"),
                       F.when(F.col("sequence") == 0, "initial").otherwise("follow_up").alias("kind"))
    best = top_k(rows, ["owner_id", "group"], [F.desc("is_default"), F.asc("opened"), F.asc("id")], 1).select("id", F.lit(True).alias("best"))
    return rows.join(best, "id", "left").select("id", "kind", "unique_name", F.coalesce("best", F.lit(False)).alias("best"))


def backfill_verdict(prospects: DataFrame) -> DataFrame:
    """The verdict of rows from before verdicts were stored: deliverable ones, the rest unknown until rechecked."""
    return prospects.withColumn("verdict", F.coalesce("verdict", F.when(F.col("email_status") == "deliverable", "deliverable")))


def backfill_threshold(campaigns: DataFrame, old: int = 70, new: int = 40) -> DataFrame:
    return campaigns.withColumn("min_score", F.when(F.col("min_score") == old, new).otherwise(F.col("min_score")))


def backfill_extracted(profiles: DataFrame) -> DataFrame:
    """Extracted fields of profiles that only have the two columns."""
    both = F.struct("team_size", "languages")
    have = F.col("team_size").isNotNull() | F.col("languages").isNotNull()
    return profiles.withColumn("extracted", F.when(have, F.to_json(both, {"ignoreNullFields": "false"})))


def prepend_owner_text(children: DataFrame, owners: DataFrame) -> DataFrame:
    """The owner's text in front of each child's, a blank line between."""
    text = owners.select(F.col("id").alias("owner_id"), F.col("prompt").alias("__owner"))
    joined = F.concat(F.trim("__owner"), F.lit("\n\n"), F.trim("prompt"))
    return children.join(text, "owner_id", "left").withColumn("prompt", F.coalesce(joined, "prompt")).drop("__owner")


def replace_phrase(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))
