"""Follow-ups, pipeline stages and validated state changes as folds of command tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import lookup
from leadloom.operators.outreach import prospect_ready, ready_prospects
from leadloom.scale import running, with_block
from leadloom.schemas import (EDITABLE, NOT_SENT, PIPELINE_STAGES, RESUME_STAGES, SENDING_STAGES, SENT, STOP_STAGES)
from leadloom.session import materialize

STOP_NOTE = "Sequence stopped ("


def latest_email(emails: DataFrame) -> DataFrame:
    """Per prospect: the email of the highest step, the last send time, and whether any was replied to."""
    return emails.groupBy("prospect_id").agg(
        F.max(F.struct("sequence_step", "id", "status", "sent_at")).alias("latest"),
        F.max("sent_at").alias("last_sent"), F.bool_or(F.col("status") == "replied").alias("any_replied"))


def _steps(follow_ups: DataFrame) -> DataFrame:
    return follow_ups.select(F.col("sequence_id").alias("email_sequence_id"), F.col("sequence").alias("step_number"),
                             "days_after_previous", F.col("template_id").alias("step_template_id"))


def follow_ups_due(prospects: DataFrame, emails: DataFrame, follow_ups: DataFrame, any_template: bool = False,
                   limit: int | None = None) -> DataFrame:
    """The next follow-up of prospects whose latest email went out without any reply."""
    live = prospects.where(~F.col("do_not_contact") & F.col("sequence_stopped_at").isNull()
                           & F.col("email_sequence_id").isNotNull()).select("id", "email_sequence_id")
    latest = latest_email(emails).where(~F.col("any_replied") & F.col("latest.status").isin(*SENT)
                                        & F.col("latest.sent_at").isNotNull())
    steps = _steps(follow_ups)
    if not any_template:
        steps = steps.where(F.col("step_template_id").isNotNull())
    due = (live.join(latest, live.id == latest.prospect_id)
           .withColumn("step_number", F.col("latest.sequence_step"))
           .join(steps, ["email_sequence_id", "step_number"])
           .select("prospect_id", (F.col("step_number") + 1).alias("step"), F.col("step_number").alias("sequence"),
                   F.col("latest.id").alias("previous_email_id"), "step_template_id"))
    return due if limit is None else due.orderBy("prospect_id").limit(limit)


def previous_step(emails: DataFrame) -> DataFrame:
    """Every email with the email one step before it (steps may have holes, so this joins on the number)."""
    before = emails.select("prospect_id", (F.col("sequence_step") + 1).alias("sequence_step"),
                           F.col("id").alias("previous_id"), F.col("status").alias("previous_status"),
                           F.col("sent_at").alias("previous_sent_at"), F.col("mailbox_id").alias("previous_mailbox_id"),
                           F.col("subject").alias("previous_subject"))
    return emails.join(before, ["prospect_id", "sequence_step"], "left")


def next_step_exists() -> Column:
    """On a row with the sequence's step after the latest email joined in."""
    return (F.col("sequence_stopped_at").isNull() & ~F.col("do_not_contact") & F.col("step_template_id").isNotNull())


def quota_exhausted(prospects: DataFrame, emails: DataFrame, follow_ups: DataFrame, now: dt.datetime,
                    reply_window_days: int = 3) -> DataFrame:
    """Leads whose last email went out over the reply window ago, with no next step and no reply."""
    moving = prospects.where(F.col("pipeline_stage").isin(*RESUME_STAGES))
    old = latest_email(emails).where((F.col("last_sent") < F.lit(now - dt.timedelta(days=reply_window_days)))
                                     & F.col("latest.status").isin(*SENT))
    rows = (moving.join(old, moving.id == old.prospect_id).withColumn("step_number", F.col("latest.sequence_step"))
            .join(_steps(follow_ups), ["email_sequence_id", "step_number"], "left"))
    return rows.where(~next_step_exists()).select("prospect_id", "pipeline_stage", "last_sent")


def without_next_step(expired: DataFrame, prospects: DataFrame, emails: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """Of the waits that ran out (prospect_id, expired_at; a stream or a table) those of leads on the way whose
    sequence has no next step, with their stage: what quota_exhausted finds by looking, as it happens."""
    moving = prospects.where(F.col("pipeline_stage").isin(*RESUME_STAGES)).withColumnRenamed("id", "prospect_id")
    latest = latest_email(emails).where(F.col("latest.status").isin(*SENT))
    rows = (expired.join(moving, "prospect_id").join(latest, "prospect_id").withColumn("step_number", F.col("latest.sequence_step"))
            .join(_steps(follow_ups), ["email_sequence_id", "step_number"], "left"))
    return rows.where(~next_step_exists()).select("prospect_id", "expired_at", "pipeline_stage")


def leads(prospects: DataFrame, emails: DataFrame) -> DataFrame:
    """Prospects on the pipeline, plus ready ones not on it yet (New Lead)."""
    on_it = prospects.where(F.col("pipeline_stage").isNotNull())
    entering = ready_prospects(prospects, emails).where(F.col("pipeline_stage").isNull())
    return on_it.unionByName(entering).withColumn("stage", F.coalesce("pipeline_stage", F.lit("new_lead")))


def infer_stage(prospects: DataFrame, emails: DataFrame) -> DataFrame:
    """The stage a prospect's emails show (only prospects with emails; NULL stays New Lead)."""
    sent = F.col("status").isin(*SENT)
    seen = emails.groupBy("prospect_id").agg(
        F.bool_or(F.col("status") == "replied").alias("replied"), F.bool_or(sent & (F.col("sequence_step") > 1)).alias("later"),
        F.bool_or(sent).alias("first"), F.bool_or(F.col("status") == "approved").alias("approved"))
    reason = F.lower(F.coalesce("sequence_stop_reason", F.lit("")))
    stage = (F.when(F.col("replied") | reason.startswith("repl"), "replied")
             .when(F.col("sequence_stopped_at").isNotNull(), "lost").when(F.col("later"), "follow_up")
             .when(F.col("first"), "initial_email").when(F.col("approved"), "ready_to_send"))
    return (prospects.join(seen, prospects.id == seen.prospect_id)
            .select(prospects.id.alias("prospect_id"), stage.alias("inferred_stage")))


# ---------------------------------------------------------------- review commands


def has_placeholder(*columns: str) -> Column:
    test = F.lit(False)
    for column in columns:
        test = test | F.coalesce(F.col(column).contains("PLACEHOLDER"), F.lit(False))
    return test


def transition_emails(emails: DataFrame, prospects: DataFrame, commands: DataFrame) -> DataFrame:
    """Approve, reject, reopen and edit commands (position, email_id, action) folded over email status.

    Several commands of one email are folded in order without a loop. An email being sent or
    already sent ignores every command. For the others, edit and reopen always leave it in review
    and reject always leaves it rejected, so the last of those before a command gives the status
    then, except that an approval that passed its checks since has turned in_review to approved.
    Both are "last seen" values. Returns one row per command: status before and after, ok, reason.
    """
    facts = prospects.select(F.col("id").alias("prospect_id"), "email_status", "approved_by_person", "outreach_status",
                             "do_not_contact", "sequence_stopped_at")
    known = emails.select(F.col("id").alias("email_id"), "prospect_id", "sequence_step", F.col("status").alias("initial"),
                          has_placeholder("subject").alias("placeholder")).join(facts, "prospect_id")
    rows = commands.join(known, "email_id").withColumns({
        "cleared": prospect_ready(F.col("sequence_step")),
        "open": F.col("initial").isin(*EDITABLE),
    })
    position, action = F.col("position"), F.col("action")
    leaves = (F.when(action.isin("edit", "reopen"), "in_review").when(action == "reject", "rejected"))
    # an edit also brings new text, given in the command, without the placeholder unless it says so
    edited = F.when((action == "edit") & F.col("open"), F.col("new_placeholder"))
    rows = with_block(rows, position, commands)
    part = F.col("__part")
    rows = running(rows, ["email_id"], part, [position], before=True,
                   lasts={"reset_to": leaves, "reset_at": F.when(leaves.isNotNull(), position), "edit_placeholder": edited})
    rows = materialize(rows)  # the second pass reads its input twice
    placeholder = F.coalesce("edit_placeholder", "placeholder")
    passes = (action == "approve") & ~placeholder & F.col("cleared")
    rows = running(rows.withColumn("has_text_left", placeholder), ["email_id"], part, [position], before=True,
                   lasts={"passed_at": F.when(passes, position)})
    base = F.coalesce("reset_to", "initial")
    approved_since = (base == "in_review") & (F.col("passed_at") > F.coalesce("reset_at", F.lit(-1)))
    before = F.when(F.col("open") & F.coalesce(approved_since, F.lit(False)), "approved").otherwise(
        F.when(F.col("open"), base).otherwise(F.col("initial")))
    rows = rows.withColumn("before", before)
    status = F.col("before")
    reason = (
        F.when(action == "approve", F.when(F.col("has_text_left"), "placeholder text left")
               .when(~F.col("cleared"), "prospect can no longer be emailed")
               .when(status != "in_review", "not in review"))
        .when(action == "reject", F.when(~status.isin(*NOT_SENT), "cannot be rejected"))
        .when(action == "reopen", F.when(~status.isin("rejected", "approved", "queued", "failed"), "cannot be reopened"))
        .when(action == "edit", F.when(~status.isin(*EDITABLE), "cannot be edited"))
        .otherwise("unknown action"))
    target = F.when(action == "approve", "approved").when(action == "reject", "rejected").otherwise("in_review")
    return rows.select("position", "email_id", "action", "before", reason.isNull().alias("ok"), reason.alias("reason"),
                       F.when(reason.isNull(), target).otherwise(status).alias("after"))


def apply_transitions(emails: DataFrame, outcome: DataFrame) -> DataFrame:
    """Emails with the status after their last command that was carried out."""
    final = outcome.where("ok").groupBy("email_id").agg(F.max_by("after", "position").alias("__after"))
    joined = emails.join(final, emails.id == final.email_id, "left")
    cleared = F.col("__after").isin("in_review", "rejected")
    return joined.select(*[
        F.coalesce("__after", "status").alias("status") if c == "status"
        else F.when(~F.coalesce(cleared, F.lit(False)), F.col("scheduled_at")).alias(c) if c == "scheduled_at"
        else emails[c] for c in emails.columns])


# ---------------------------------------------------------------- stages


def stage_order(column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(value) for value, _ in PIPELINE_STAGES]), column)


def stage_label(column: Column) -> Column:
    return lookup(column, dict(PIPELINE_STAGES))


def advance_stage(prospects: DataFrame, signals: DataFrame) -> DataFrame:
    """Sending moves leads forward among the sending stages only (signals: prospect_id, stage).

    Moving forward never goes back, so of several signals the furthest decides.
    """
    furthest = (signals.where(F.col("stage").isin(*SENDING_STAGES)).groupBy("prospect_id")
                .agg(F.max_by("stage", stage_order(F.col("stage"))).alias("to_stage")))
    current = F.coalesce("pipeline_stage", F.lit("new_lead"))
    moves = current.isin(*SENDING_STAGES) & (stage_order(F.col("to_stage")) > stage_order(current))
    return (prospects.join(furthest, prospects.id == furthest.prospect_id)
            .where(moves).select("prospect_id", F.col("pipeline_stage").alias("from_stage"), "to_stage"))


def move_stage(prospects: DataFrame, moves: DataFrame) -> DataFrame:
    """A person's moves (position, prospect_id, stage) in order, with what each did.

    A move to the current stage does nothing. Only a resume of a stopped do-not-contact lead is
    refused; such a lead, once stopped, stays stopped, so "stopped before this move" is a running
    count of stop moves (one onto the initial stage before anything else changed does not count).
    """
    state = prospects.select(F.col("id").alias("prospect_id"), F.coalesce("pipeline_stage", F.lit("new_lead")).alias("initial"),
                             F.col("sequence_stopped_at").isNotNull().alias("stopped_first"), "do_not_contact")
    rows = moves.join(state, "prospect_id")
    position, stage = F.col("position"), F.col("stage")
    rows = with_block(rows, position, moves)
    key, block, order = ["prospect_id"], F.col("__part"), [position]
    rows = running(rows, key, block, order, before=True, sums={"left_initial": F.when(stage != F.col("initial"), 1).otherwise(0)})
    rows = materialize(rows)  # every later pass reads its input twice; kept, the work stays linear
    real_stop = stage.isin(*STOP_STAGES) & ((stage != F.col("initial")) | (F.col("left_initial") > 0))
    rows = running(rows, key, block, order, before=True, sums={"stops": real_stop.cast("int")})
    rows = materialize(rows)
    resumes = stage.isin(*RESUME_STAGES)
    refused = resumes & F.col("do_not_contact") & (F.col("stopped_first") | (F.col("stops") > 0))
    rows = running(rows.withColumn("refused", refused), key, block, order, before=True,
                   lasts={"moved_to": F.when(~F.col("refused"), stage)})
    rows = materialize(rows.withColumn("from_stage", F.coalesce("moved_to", "initial")))
    stays = stage == F.col("from_stage")
    # the last stop or resume that was not refused decides whether the lead is stopped now
    flips = F.when(~F.col("refused") & ~stays & stage.isin(*STOP_STAGES), True).when(
        ~F.col("refused") & ~stays & resumes, False)
    rows = running(rows.withColumn("stays", stays), key, block, order, before=True, lasts={"stop_state": flips})
    stopped = F.coalesce("stop_state", "stopped_first")
    outcome = (F.when(F.col("stays"), "already there").when(F.col("refused") & stopped, "refused: do-not-contact")
               .when(stage.isin(*STOP_STAGES), "moved and stopped").when(resumes & stopped, "moved and resumed")
               .otherwise("moved"))
    return rows.select("position", "prospect_id", "from_stage", F.col("stage").alias("to_stage"), outcome.alias("outcome"))


def stage_log(outcome: DataFrame) -> DataFrame:
    """The stage changes the moves log."""
    return outcome.where(F.col("outcome").startswith("moved")).select("position", "prospect_id", "from_stage", "to_stage")


def stop_prospects(prospects: DataFrame, emails: DataFrame, stops: DataFrame,
                   now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Stop sequences (stops: position, prospect_id, reason) and cancel the emails not sent yet; the first stop of a prospect counts."""
    chosen = stops.groupBy("prospect_id").agg(F.min_by(F.coalesce("reason", F.lit("")), "position").alias("__reason"))
    text = F.left(F.trim(F.coalesce(F.nullif("__reason", F.lit("")), F.lit("stopped"))), F.lit(64))
    people = prospects.join(chosen, prospects.id == chosen.prospect_id, "left")
    fresh = F.col("__reason").isNotNull() & F.col("sequence_stopped_at").isNull()
    people = people.select(*[
        F.when(fresh, F.lit(now)).otherwise(F.col(c)).alias(c) if c == "sequence_stopped_at"
        else F.when(fresh, text).otherwise(F.col(c)).alias(c) if c == "sequence_stop_reason"
        else prospects[c] for c in prospects.columns])
    mail = emails.join(chosen.withColumnRenamed("prospect_id", "__prospect"),
                       F.col("prospect_id") == F.col("__prospect"), "left")
    cancelled = F.col("__reason").isNotNull() & F.col("status").isin(*NOT_SENT)
    note = F.when(cancelled, F.concat(F.lit(STOP_NOTE), text, F.lit(").")))
    mail = mail.withColumn("__status", F.when(cancelled, "rejected").otherwise(F.col("status")))
    mail = mail.select(*[
        F.col("__status").alias(c) if c == "status"
        else F.when(~cancelled, F.col(c)).alias(c) if c in ("scheduled_at", "queued_at")
        else emails[c] for c in emails.columns if c != "review_note"],
        (F.coalesce(note, F.col("review_note")) if "review_note" in emails.columns else note).alias("review_note"))
    return people, mail


def resume_prospects(prospects: DataFrame, emails: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undo stops (ids: prospect_id): replied counts as sent again, emails the stop cancelled go back to review.

    Returns prospects, emails and the refused ones (do-not-contact) with their reason.
    """
    chosen = ids.select("prospect_id").distinct()
    asked = prospects.join(chosen, prospects.id == chosen.prospect_id, "left_semi").where(
        F.col("sequence_stopped_at").isNotNull())
    refused = asked.where("do_not_contact").select(F.col("id").alias("prospect_id"),
                                                   F.lit("do-not-contact; clear that first").alias("reason"))
    back = asked.where(~F.col("do_not_contact")).select(F.col("id").alias("__back"))
    people = prospects.join(back, prospects.id == F.col("__back"), "left").select(*[
        F.when(F.col("__back").isNull(), F.col(c)).alias(c) if c in ("sequence_stopped_at", "sequence_stop_reason")
        else prospects[c] for c in prospects.columns])
    mail = emails.join(back, F.col("prospect_id") == F.col("__back"), "left")
    restored = (F.col("__back").isNotNull() & (F.col("status") == "rejected")
                & F.coalesce(F.col("review_note").startswith(STOP_NOTE), F.lit(False)))
    unreplied = F.col("__back").isNotNull() & (F.col("status") == "replied")
    mail = mail.withColumns({"__restored": restored, "__unreplied": unreplied})
    mail = mail.select(*[
        F.when(F.col("__restored"), "in_review").when(F.col("__unreplied"), "sent").otherwise(F.col(c)).alias(c)
        if c == "status" else F.when(~F.col("__restored"), F.col(c)).alias(c)
        if c in ("review_note", "reviewed_at", "scheduled_at") else emails[c] for c in emails.columns])
    return people, mail, refused


def record_sent(prospects: DataFrame, emails: DataFrame, follow_ups: DataFrame, sends: DataFrame) -> DataFrame:
    """Sends (email_id, sent_at) of due emails: the new email, outreach and stage values, and what comes next."""
    latest = sends.groupBy("email_id").agg(F.max("sent_at").alias("new_sent_at"))
    mail = emails.join(latest, emails.id == latest.email_id).select("email_id", "prospect_id", "sequence_step", "new_sent_at")
    rows = (mail.join(prospects.withColumnRenamed("id", "prospect_id"), "prospect_id")
            .withColumn("step_number", F.col("sequence_step"))
            .join(_steps(follow_ups), ["email_sequence_id", "step_number"], "left"))
    first = F.col("sequence_step") == 1
    stage = F.when(first, "initial_email").otherwise("follow_up")
    current = F.coalesce("pipeline_stage", F.lit("new_lead"))
    moves = current.isin(*SENDING_STAGES) & (stage_order(stage) > stage_order(current))
    return rows.select(
        "email_id", "prospect_id", F.lit("sent").alias("status"), "new_sent_at", F.lit("contacted").alias("outreach_status"),
        F.when(moves, stage).otherwise(F.col("pipeline_stage")).alias("pipeline_stage"),
        F.when(next_step_exists(), F.concat(F.lit("follow-up "), F.col("sequence_step").cast("string")))
        .otherwise("sequence finished").alias("next"))


def mark_business_replied(emails: DataFrame, ids: DataFrame) -> DataFrame:
    """The email a reply of each business (ids: business_id) is recorded on: its latest sent one."""
    asked = ids.select("business_id").distinct()
    return (emails.where(F.col("status").isin(*SENT)).join(asked, "business_id", "left_semi").groupBy("business_id")
            .agg(F.max(F.struct("sent_at", "id", "prospect_id")).alias("l"))
            .select("business_id", F.col("l.id").alias("email_id"), F.col("l.prospect_id").alias("prospect_id")))


def review_prospects(prospects: DataFrame, commands: DataFrame) -> DataFrame:
    """A person's approvals and rejections (position, prospect_id, action) in order: the last action and what they leave.

    Undeliverable addresses are never approved, contacted ones never rejected; those are skipped. A
    rejection that is carried out wins over all before it, and an approval only acts on what waits or
    was rejected, so the last action and whether any rejection came before it tell the whole fold.
    """
    chosen = commands.groupBy("prospect_id").agg(F.max_by("action", "position").alias("action"), F.bool_or(F.col("action") == "reject").alias("__rejects"))
    rows = prospects.join(chosen, prospects.id == chosen.prospect_id)
    contacted = F.col("outreach_status") == "contacted"
    rejected = F.col("__rejects") & ~contacted
    before = F.when(rejected, "rejected").otherwise(F.col("outreach_status"))
    approves = before.isin("needs_review", "pending", "rejected") & (F.coalesce("email_status", F.lit("")) != "undeliverable")
    approved = (F.col("action") == "approve") & approves
    return rows.select(
        "prospect_id", "action", F.when(F.col("action") == "approve", approves).otherwise(~contacted).alias("done"),
        F.when(approved, "ready").otherwise(before).alias("outreach_status"),
        F.when(approved, True).when(rejected, False).otherwise(F.col("approved_by_person")).alias("approved_by_person"))


def set_do_not_contact(prospects: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    chosen = ids.select(F.col("prospect_id").alias("__id")).distinct()
    return prospects.join(chosen, prospects.id == F.col("__id"), "left").select(*[
        F.when(F.col("__id").isNotNull(), F.lit(value)).otherwise(F.col(c)).alias(c) if c == "do_not_contact"
        else prospects[c] for c in prospects.columns])
