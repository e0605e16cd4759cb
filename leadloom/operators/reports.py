"""Dashboards: zero-filled counts, rates, grouping sets, boards and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.operators.lifecycle import stage_label
from leadloom.scale import top_k, with_block
from leadloom.schemas import EMAIL_STATUSES, PIPELINE_STAGES


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even; NULL when there is no whole."""
    return F.bround(F.lit(100) * part / F.nullif(whole, F.lit(0))).cast("int")


def enumeration(like: DataFrame, values, key: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias(key)) for i, v in enumerate(values)])
    return like.sparkSession.range(1).select(F.inline(rows))


def zero_filled(df: DataFrame, key: str, values) -> DataFrame:
    """Counts per enumeration value in display order, zero where none."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    return (enumeration(df, values, key).join(counts, key, "left")
            .select("position", key, F.coalesce("__n", F.lit(0)).alias("n")))


def status_counts(emails: DataFrame) -> DataFrame:
    return zero_filled(emails, "status", EMAIL_STATUSES)


def open_rate(emails: DataFrame, tracking: bool = True) -> DataFrame:
    opened, sent = F.count_if(F.col("status") == "opened"), F.count_if(F.col("status").isin("sent", "opened"))
    rate = percent(opened, sent) if tracking else F.lit(None).cast("int")
    return emails.agg(opened.alias("opened"), sent.alias("sent"), rate.alias("open_rate"))


def count_by(df: DataFrame, metric: str, column: str | None = None) -> DataFrame:
    """Long-form counts (metric, key, n); NULL keys are kept."""
    if column is None:
        return df.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), F.lit("total").alias("key"), "n")
    return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).select(
        F.lit(metric).alias("metric"), "key", "n")


def pipeline_stats(campaigns, businesses, profiles, contacts, prospects, emails, runs=None) -> DataFrame:
    parts = [count_by(campaigns, "campaigns", "status"), count_by(businesses, "businesses"),
             count_by(profiles, "website_research", "status"),
             count_by(profiles.where(F.col("contact_discovery_status").isNotNull()), "contact_discovery",
                      "contact_discovery_status"),
             count_by(contacts, "contacts"), count_by(prospects, "prospects", "outreach_status"),
             status_counts(emails).select(F.lit("emails").alias("metric"), F.col("status").alias("key"), "n")]
    if runs is not None:
        parts.append(count_by(runs, "runs", "status"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


USAGE_SUMS = ("input_tokens", "output_tokens", "reasoning_tokens", "credits")


def usage_summary(usage: DataFrame) -> DataFrame:
    """Totals and per (action, provider, model) in one pass (GROUPING SETS)."""
    keys = ["action", "provider", "model"]
    sums = [F.sum(c).alias(c) for c in USAGE_SUMS]
    sets = usage.groupingSets([[], [F.col(k) for k in keys]], *keys)
    return sets.agg((F.grouping_id() != 0).alias("is_total"), *sums, F.count("*").alias("calls"))


def usage_credits(action: Column, emails_returned: Column, finished: Column) -> Column:
    """Estimated credits: 1 per started 10 emails of a domain search, 0.5 per finished check."""
    search = F.ceil(emails_returned / 10).cast("decimal(8,2)")
    check = F.when(finished, F.lit("0.5").cast("decimal(8,2)")).otherwise(F.lit(0).cast("decimal(8,2)"))
    zero = F.lit(0).cast("decimal(8,2)")
    return F.coalesce(F.when(action == "decision_makers", search).when(action == "verification", check), zero)


def day_range(df: DataFrame, column: str, first: str | None, last: str | None, zone: str = "UTC") -> DataFrame:
    """Rows of the local days first..last, both included; a bad date is ignored."""
    def start(text: str, add: int) -> Column:
        return F.to_utc_timestamp(F.date_add(F.try_to_date(F.lit(text), "yyyy-MM-dd"), add).cast("timestamp"), zone)

    if first:
        bound = start(first, 0)
        df = df.where(bound.isNull() | (F.col(column) >= bound))
    if last:
        bound = start(last, 1)
        df = df.where(bound.isNull() | (F.col(column) < bound))
    return df


def search_text(df: DataFrame, columns: list[str], text: str | None) -> DataFrame:
    """Case-insensitive substring in any column; blank text filters nothing."""
    text = (text or "").strip()
    if not text:
        return df
    test = F.lit(False)
    for column in columns:
        test = test | F.coalesce(F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))
    return df.where(test)


_LOOKUPS = {
    "exact": lambda c, v: c == F.lit(v), "gte": lambda c, v: c >= F.lit(v), "lte": lambda c, v: c <= F.lit(v),
    "icontains": lambda c, v: F.contains(F.lower(c.cast("string")), F.lit(str(v).lower())),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def browse(df: DataFrame, filters: dict | None = None, search: str | None = None, search_columns: list[str] = (),
           order: list[Column] = (), page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of a table: ``column__lookup`` filters, search, order."""
    for name, value in (filters or {}).items():
        column, _, lookup = name.partition("__")
        df = df.where(_LOOKUPS[lookup or "exact"](F.col(column), value))
    df = search_text(df, list(search_columns), search)
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


# Default order of each table; a descending score puts unscored rows first, as stored.
DEFAULT_ORDER = {
    "campaign_prompts": lambda: [F.asc_nulls_last("name")],
    "email_templates": lambda: [F.asc_nulls_last("kind"), F.asc_nulls_last("name")],
    "email_sequences": lambda: [F.asc_nulls_last("name")],
    "follow_ups": lambda: [F.asc("sequence_id"), F.asc("sequence")],
    "campaigns": lambda: [F.desc_nulls_first("created_at")],
    "mailboxes": lambda: [F.asc("priority"), F.asc("id")],
    "businesses": lambda: [F.asc("id")],
    "business_sources": lambda: [F.asc("id")],
    "website_profiles": lambda: [F.desc_nulls_first("qualification_score"), F.asc("business_id")],
    "contacts": lambda: [F.asc("business_id"), F.desc_nulls_first("is_primary"), F.asc("id")],
    "prospects": lambda: [F.asc("id")],
    "stage_changes": lambda: [F.desc_nulls_first("changed_at"), F.desc("id")],
    "emails": lambda: [F.asc("id")],
    "email_open_events": lambda: [F.desc_nulls_first("opened_at")],
    "pipeline_runs": lambda: [F.desc_nulls_first("created_at")],
    "usage_records": lambda: [F.desc_nulls_first("created_at"), F.desc("id")],
}


def sequence_results(emails: DataFrame, prospects: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sent emails and reply rate per sequence and step."""
    sent = emails.where(F.col("sent_at").isNotNull()).select("prospect_id", "sequence_step", "status")
    group = prospects.select(F.col("id").alias("prospect_id"), "email_sequence_id")
    counts = sent.join(group, "prospect_id").groupBy("email_sequence_id", "sequence_step").agg(
        F.count("*").alias("sent"), F.count_if(F.col("status") == "replied").alias("replied"))
    names = sequences.select(F.col("id").alias("email_sequence_id"), "name")
    step = F.col("sequence_step")
    return counts.join(names, "email_sequence_id", "left").select(
        F.when(step == 1, "First email").otherwise(F.concat(F.lit("Follow-up "), (step - 1).cast("string"))).alias("step"),
        F.coalesce("name", F.lit("-")).alias("variation"), "sent", "replied",
        percent(F.col("replied"), F.col("sent")).alias("reply_rate"))


def stage_counts(leads: DataFrame) -> DataFrame:
    return zero_filled(leads, "stage", [value for value, _ in PIPELINE_STAGES])


def board(leads: DataFrame, k: int = 200) -> DataFrame:
    """The newest k cards of each stage with the stage's total and overflow."""
    cards = top_k(leads.select("id", "stage", "stage_changed_at"), ["stage"],
                  [F.desc_nulls_first("stage_changed_at"), F.desc("id")], k)
    totals = leads.groupBy("stage").agg(F.count("*").alias("total"))
    return cards.join(totals, "stage").withColumn("more", F.greatest(F.col("total") - k, F.lit(0)))


def stage_history(changes: DataFrame, k: int = 20) -> DataFrame:
    """The newest k moves of each lead, with labels."""
    newest = top_k(changes, ["prospect_id"], [F.desc("changed_at"), F.desc("id")], k)
    return newest.select("prospect_id", "rank", F.coalesce(stage_label(F.col("from_stage")), F.lit("New Lead")).alias("from_label"),
                         stage_label(F.col("to_stage")).alias("to_label"), "changed_at")


def next_in_review(emails: DataFrame) -> DataFrame:
    """For every email in review the next one, wrapping to the first; NULL when it is the only one.

    Ids are cut into counted blocks: ``lead`` looks inside a block, the last id of a block takes the
    first id of the next block that has any. Only one row per block, at most ``scale.BLOCKS``, is in order overall.
    """
    waiting = emails.where(F.col("status") == "in_review").select("id")
    waiting = with_block(waiting, F.col("id"), name="__block")
    firsts = waiting.groupBy("__block").agg(F.min("id").alias("__first"))
    overall = Window.partitionBy(F.lit(1)).orderBy("__block")
    wrap = F.min("__first").over(overall.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = firsts.select("__block", F.lead("__first").over(overall).alias("__next"), wrap.alias("__wrap"))
    inside = F.lead("id").over(Window.partitionBy("__block").orderBy("id"))
    found = waiting.withColumn("__inside", inside).join(following, "__block")
    target = F.coalesce("__inside", "__next", F.when(F.col("__wrap") != F.col("id"), F.col("__wrap")))
    return found.select("id", target.alias("next_id"))


def duplicate_keys(df: DataFrame, key: str, first: int = 20) -> DataFrame:
    """Non-empty keys stored more than once (the first few, by key) with their ids, one row per id."""
    repeated = (df.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))
                .where(F.col("n") > 1).orderBy(key).limit(first))
    return df.select(key, "id").join(repeated, key)


def latest_slots(emails: DataFrame, holders: tuple[str, ...]) -> DataFrame:
    return (emails.where(F.col("status").isin(*holders) & F.col("scheduled_at").isNotNull()).groupBy("mailbox_id")
            .agg(F.max("scheduled_at").alias("latest_slot")))


def research_fields(prompts: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """First description of every output field over all prompts, in prompt order; reserved names excluded."""
    fields = prompts.select("id", F.posexplode("output_fields").alias("pos", "field"))
    return (fields.where(~F.col("field.name").isin(*reserved) if reserved else F.lit(True))
            .groupBy(F.col("field.name").alias("name"))
            .agg(F.min_by(F.concat(F.lit("From research: "), F.col("field.description")), F.struct("id", "pos"))
                 .alias("description")))


def step_outcomes(run_log: DataFrame, steps: list[str]) -> DataFrame:
    """Per run and step: ok, partial, stopped or not run (a hard error stops the run).

    ``run_log``: run_id, step, outcome (ok/partial/error), remaining.
    """
    plan = enumeration(run_log, steps, "step")
    seen = run_log.join(plan, "step").groupBy("run_id").agg(
        F.min(F.when(F.col("outcome") == "error", F.col("position"))).alias("stopped_at"))
    grid = seen.select("run_id", "stopped_at", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("step")) for i, s in enumerate(steps)])))
    logged = run_log.groupBy("run_id", "step").agg(F.max("outcome").alias("outcome"), F.sum("remaining").alias("remaining"))
    state = (F.when(F.col("position") > F.col("stopped_at"), "not run").when(F.col("position") == F.col("stopped_at"), "stopped")
             .otherwise(F.coalesce("outcome", F.lit("not run"))))
    return grid.join(logged, ["run_id", "step"], "left").select(
        "run_id", "position", "step", state.alias("state"), F.coalesce("remaining", F.lit(0)).alias("remaining"))


def stacked(sources: list[tuple[DataFrame, dict[int, tuple[str, str]]]]) -> DataFrame:
    """One-row counts as labelled rows: per source its columns as position -> (label, column).

    Each source is read once, however many labels come from it.
    """
    result = None
    for df, labels in sources:
        rows = df.select(F.inline(F.array(*[
            F.struct(F.lit(position).alias("position"), F.lit(label).alias("label"), F.col(column).cast("long").alias("n"))
            for position, (label, column) in labels.items()])))
        result = rows if result is None else result.unionByName(rows)
    return result
