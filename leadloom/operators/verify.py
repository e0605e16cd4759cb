"""Which addresses to check, shortcuts per domain, exclusion patterns and the score gate."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import lookup
from leadloom.scale import join_summary, running, top_k, with_block
from leadloom.schemas import CONCLUSIVE

# Names that cannot receive mail (RFC 2606, RFC 6761).
RESERVED_DOMAINS = ("example.com", "example.net", "example.org", "localhost")
RESERVED_TLDS = ("example", "invalid", "test", "localhost", "local")
SCORABLE_STATUS = ("deliverable", "risky", "unknown")
SCORABLE_OUTREACH = ("pending", "needs_review")


def present(df: DataFrame, names: dict[str, str]) -> list[Column]:
    """The columns a table has, under their new names."""
    return [F.col(old).alias(new) for old, new in names.items() if old in df.columns]


def domain_of(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def reserved_domain(host: Column) -> Column:
    """The host or any parent is reserved, or its last label is."""
    clean = F.rtrim(F.lower(host), F.lit("."))
    dotted = F.concat(F.lit("."), clean)
    parent = F.lit(False)
    for name in RESERVED_DOMAINS:
        parent = parent | dotted.endswith("." + name)
    return parent | F.substring_index(clean, ".", -1).isin(*RESERVED_TLDS)


# ---------------------------------------------------------------- exclusion patterns


def glob_to_regex(pattern: str) -> str:
    """Shell glob (``*``, ``?``, ``[..]``) as an anchored regular expression; a lone ``[`` is literal."""
    out, at = [], 0
    while at < len(pattern):
        char = pattern[at]
        close = pattern.find("]", at + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[at + 1:close]
            negate = inner.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", inner[1:] if negate else inner)
            out.append(f"[{'^' if negate else ''}{body}]")
            at = close
        else:
            out.append(re.sub(r"([^A-Za-z0-9_@\x80-\U0010ffff])", r"\\\1", char))
        at += 1
    return "^(?s:" + "".join(out) + r")\z"


def excluded_pattern(address: Column, patterns) -> Column:
    """The first pattern (in list order) the trimmed, lower-cased address matches, or NULL."""
    value = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    cleaned = [p.strip().lower() for p in patterns if p.strip()]
    tests = [F.when(value.rlike(glob_to_regex(p)), F.lit(p)) for p in cleaned]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def exclusion_note(pattern: Column) -> Column:
    return F.concat(F.lit("Excluded: matches the pattern "), pattern, F.lit(" (Settings), so it is never emailed."))


def apply_exclusions(prospects: DataFrame, patterns, now: dt.datetime) -> DataFrame:
    """Prospects with matching, not yet decided addresses rejected and their score cleared."""
    open_ = (F.col("outreach_status").isin("pending", "needs_review", "ready") & ~F.col("approved_by_person")
             & (F.coalesce("verdict", F.lit("")) != "excluded"))
    rows = prospects.withColumn("__pattern", F.when(open_, excluded_pattern(F.col("email"), patterns)))
    hit = F.col("__pattern").isNotNull()
    return rows.withColumns({
        "outreach_status": F.when(hit, "rejected").otherwise(F.col("outreach_status")),
        "email_score": F.when(~hit, F.col("email_score")),
        "email_scored_at": F.when(hit, F.lit(now)).otherwise(F.col("email_scored_at")),
        "exclusion": F.when(hit, exclusion_note(F.col("__pattern"))),
    }).drop("__pattern")


# ---------------------------------------------------------------- queues


def verification_queue(contacts: DataFrame, profiles: DataFrame, *, primary_only: bool = False, min_score: int | None = None,
                       limit: int | None = None) -> DataFrame:
    """Contacts to check, by business, primary first; the limit counts contacts, not addresses."""
    queue = contacts.where("is_primary") if primary_only else contacts
    if min_score is not None:
        good = profiles.where(F.col("qualification_score") >= min_score).select("business_id")
        queue = queue.join(good, "business_id", "left_semi")
    queue = queue.orderBy("business_id", F.desc("is_primary"), "id")
    return queue if limit is None else queue.limit(limit)


def candidate_addresses(contacts: DataFrame, cap: int = 0) -> DataFrame:
    """(contact_id, position, address): the own email first, then the candidates, trimmed, each once
    ignoring case in its first spelling; at most ``cap`` when given."""
    entries = F.concat(F.array("email"), F.coalesce(F.transform("candidate_emails", lambda c: c["email"]),
                                                     F.array().cast("array<string>")))
    clean = F.filter(F.transform(entries, lambda e: F.trim(e)), lambda e: e.isNotNull() & F.contains(e, F.lit("@")))
    rows = contacts.select(F.col("id").alias("contact_id"), clean.alias("a"))
    folded = rows.withColumn("f", F.transform("a", lambda a: F.lower(a)))
    # an entry stays when nothing equal stands before it
    kept = F.filter("a", lambda a, i: F.array_position(F.col("f"), F.lower(a)) == i + 1)
    kept = F.slice(kept, 1, cap) if cap else kept
    return folded.select("contact_id", F.posexplode(kept).alias("position", "address"))


def undecided(candidates: DataFrame, prospects: DataFrame, recheck: bool = False, paid_provider: str | None = None) -> DataFrame:
    """Candidates whose address has no conclusive result yet (unknown is checked again). With a paid
    provider, neither those it answered before, unless that check failed."""
    if recheck:
        return candidates
    done = F.col("email_status").isin(*CONCLUSIVE)
    if paid_provider:
        done = done | ((F.col("email_verification_provider") == paid_provider) & (F.coalesce("verdict", F.lit("")) != "check_failed"))
    decided = prospects.where(done).select("contact_id", F.col("email").alias("address"))
    return candidates.join(decided, ["contact_id", "address"], "left_anti")


def scoring_queue(prospects: DataFrame, rescore: bool = False, limit: int | None = None) -> DataFrame:
    """Verified addresses waiting for a score (a NULL verdict is not an excluded one)."""
    queue = prospects.where(~F.col("do_not_contact") & ~F.col("approved_by_person")
                            & F.col("outreach_status").isin(*SCORABLE_OUTREACH) & F.col("email_status").isin(*SCORABLE_STATUS)
                            & (F.coalesce("verdict", F.lit("")) != "excluded"))
    if not rescore:
        queue = queue.where(F.col("email_scored_at").isNull())
    return queue if limit is None else queue.orderBy("business_id", "id").limit(limit)


def sibling_addresses(prospects: DataFrame, k: int = 12) -> DataFrame:
    """(id, siblings): up to k other addresses of the business, by id, excluded ones left out.

    The first k+1 per business serve every prospect of it, whichever one of them is itself; a business with a third of all prospects is
    one summary row to them. Prospects without business have no siblings.
    """
    usable = prospects.where(F.col("business_id").isNotNull() & (F.coalesce("verdict", F.lit("")) != "excluded"))
    first = top_k(usable.select("business_id", "id", "email", "email_status"), ["business_id"], [F.col("id")], k + 1)
    lists = first.groupBy("business_id").agg(F.array_sort(F.collect_list(F.struct("id", "email", "email_status"))).alias("__first"))
    sizes = prospects.groupBy("business_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = join_summary(prospects.select("id", "business_id"), sizes.join(lists, "business_id", "left"), ["business_id"], "__n")
    others = F.slice(F.filter("__first", lambda s: s["id"] != F.col("id")), 1, k)
    return rows.select(
        "id", F.coalesce(F.transform(others, lambda s: F.struct(s["email"].alias("address"), s["email_status"].alias("status"))),
                         F.array().cast("array<struct<address:string,status:string>>")).alias("siblings"))


def scoring_context(queue: DataFrame, prospects: DataFrame, businesses: DataFrame, profiles: DataFrame, contacts: DataFrame) -> DataFrame:
    """(id, context): the document a scorer sees about each address, as JSON."""
    business = businesses.select(F.col("id").alias("business_id"), F.struct(*present(businesses, {
        "name": "name", "category": "category", "city": "city", "country": "country", "website_url": "website", "google_rating": "google_rating",
        "google_review_count": "google_review_count"})).alias("b"))
    profile = profiles.select("business_id", F.col("qualification_score").alias("profile_score"),
                              *present(profiles, {"qualification_reasons": "reasons"}))
    contact = contacts.select(F.col("id").alias("contact_id"), F.struct(*present(contacts, {
        "name": "name", "job_title": "job_title", "role_type": "role_type", "email_source": "found_by", "is_primary": "is_primary_contact",
        "confidence": "confidence", "linkedin_url": "linkedin", "discovery_reasoning": "why_chosen"})).alias("contact"))
    checked = present(queue, {"email_status": "status", "verdict": "verdict", "verification_note": "note", "email_verification_provider": "provider"})
    rows = (queue.select("id", "business_id", "contact_id", "email", F.struct(*checked).alias("verification"))
            .join(business, "business_id").join(contact, "contact_id").join(profile, "business_id", "left")
            .join(sibling_addresses(prospects), "id"))
    reasons = [F.col("reasons").alias("qualification_reasons")] if "reasons" in profile.columns else []
    document = F.struct(F.col("email").alias("address"), "verification", "contact",
                        F.struct("b.*", F.col("profile_score").alias("qualification_score"), *reasons).alias("business"),
                        F.col("siblings").alias("other_addresses_at_this_business"))
    return rows.select("id", F.to_json(document).alias("context"))


# ---------------------------------------------------------------- outcomes


def outreach_for(status: Column, verdict: Column, require_score: bool) -> Column:
    deliverable = F.lit("pending" if require_score else "ready")
    return (F.when(verdict == "excluded", "rejected").when(status == "deliverable", deliverable)
            .when(status == "undeliverable", "rejected").otherwise("needs_review"))


def decide(status: Column, score: Column, minimum: int) -> Column:
    return F.when((status == "deliverable") & (score >= minimum), "ready").otherwise("needs_review")


def clamp_score(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def apply_scores(prospects: DataFrame, scores: DataFrame, minimum: int, now: dt.datetime) -> DataFrame:
    """Write scores (position, id, score, reasoning) in order while the prospect still waits for a decision.

    A score below the minimum leaves a prospect open for the next; one that makes it ready closes it, so
    the first of those counts, or else the last of all.
    """
    written = F.struct(clamp_score(F.col("score")).alias("score"),
                       F.left(F.trim(F.regexp_replace("reasoning", r"(?U)\s+", " ")), F.lit(2000)).alias("reasoning"))
    enough = F.when(clamp_score(F.col("score")) >= minimum, F.col("position"))
    one = scores.groupBy("id").agg(F.min_by(written, enough).alias("__first"), F.max_by(written, "position").alias("__last"))
    rows = prospects.join(one, "id", "left")
    closes = (F.col("email_status") == "deliverable") & F.col("__first").isNotNull()
    rows = rows.withColumn("__new", F.when(closes, F.col("__first")).otherwise(F.col("__last"))).drop("__first", "__last")
    open_ = F.col("__new").isNotNull() & F.col("outreach_status").isin(*SCORABLE_OUTREACH)
    return rows.withColumns({
        "outreach_status": F.when(open_, decide(F.col("email_status"), F.col("__new.score"), minimum)).otherwise(F.col("outreach_status")),
        "email_score": F.when(open_, F.col("__new.score")).otherwise(F.col("email_score")),
        "email_score_reason": F.when(open_, F.col("__new.reasoning")),
        "email_scored_at": F.when(open_, F.lit(now)).otherwise(F.col("email_scored_at")),
    }).drop("__new")


def catch_all_domains(prospects: DataFrame) -> DataFrame:
    """Domains an earlier run itself probed and found catch-all."""
    probed = prospects.where((F.col("verdict") == "catch_all") & F.col("probed") & F.contains(F.col("email"), F.lit("@")))
    return probed.select(domain_of(F.col("email")).alias("domain")).distinct()


# What a domain's state says about its other addresses: (status, note, verdict).
SHORTCUTS = {
    "check_failed": ("unknown", "the mail server did not answer"),
    "catch_all": ("risky", "the domain accepts mail for any address (catch-all)"),
    "smtp_unreachable": ("unknown", "Reacher could not connect to the mail server"),
    "blocked": ("unknown", "the mail server refused the checks"),
}
EARLIER_CATCH_ALL = "the domain accepts mail for any address (catch-all, found in an earlier run)"


def domain_shortcut() -> Column:
    """The state an outcome puts its whole domain in, or NULL (outcome_a columns)."""
    return (F.when(~F.col("answered"), "check_failed").when(F.col("is_catch_all"), "catch_all")
            .when(~F.col("can_connect_smtp"), "smtp_unreachable")
            .when((F.col("status") == "unknown") & ~F.col("retryable"), "blocked"))


def shortcut_domains(checks: DataFrame, known_catch_all: DataFrame, patterns=()) -> DataFrame:
    """Checks of a run (position, address, outcome_a columns) as that run would have recorded them.

    The first address of a domain whose outcome decides the domain is probed; later ones inherit
    its answer unprobed. Domains known from earlier runs decide all theirs. Patterns go first.
    An address that inherits never probes, so the first deciding outcome in order is the decider.
    """
    rows = checks.withColumns({"domain": domain_of(F.col("address")), "pattern": excluded_pattern(F.col("address"), patterns)})
    deciding = F.when(F.col("pattern").isNull(), domain_shortcut())
    state = rows.where(deciding.isNotNull()).groupBy("domain").agg(
        F.min("position").alias("decided_at"), F.min_by(deciding, "position").alias("state"))
    earlier = known_catch_all.select("domain", F.lit(True).alias("known")).distinct()
    sizes = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("__rows"))
    facts = sizes.join(state, "domain", "left").join(earlier, "domain", "left")
    rows = join_summary(rows, facts, ["domain"], "__rows")
    inherits = F.col("known") | (F.col("position") > F.col("decided_at"))
    source = F.when(F.col("pattern").isNotNull(), "pattern").when(F.col("known"), "known").when(inherits, "run").otherwise("probe")
    verdict = F.when(F.col("known"), "catch_all").otherwise(F.col("state"))
    status, note = lookup(verdict, {k: s for k, (s, _) in SHORTCUTS.items()}), lookup(verdict, {k: t for k, (_, t) in SHORTCUTS.items()})
    note = F.when(F.col("known"), EARLIER_CATCH_ALL).otherwise(note)
    rows = rows.withColumn("source", source)
    own, other = F.col("source") == "probe", F.col("source") == "pattern"
    return rows.select(
        "position", "address", "source", own.alias("probed"),
        F.when(own, F.col("status")).when(other, "unknown").otherwise(status).alias("status"),
        F.when(own, F.col("verdict")).when(other, "excluded").otherwise(verdict).alias("verdict"),
        F.when(own, F.col("note")).when(other, exclusion_note(F.col("pattern")))
        .otherwise(F.concat(F.lit("not checked: "), note)).alias("note"))


def failure_streak(checks: DataFrame, k: int = 3) -> DataFrame:
    """Per run the position at which it stops: the k-th address in a row without an SMTP connection.

    A connection resets the count, an unknown connection neither counts nor resets. Running counts
    of failures and of resets turn "in a row" into "the k-th failure since the last reset".
    """
    fails = F.when(~F.col("can_connect_smtp"), 1).otherwise(0)
    resets = F.when(F.col("can_connect_smtp"), 1).otherwise(0)
    rows = with_block(checks.select("run_id", "position", "can_connect_smtp"), F.col("position"))
    counted = running(rows, ["run_id"], F.col("__part"), [F.col("position")],
                      sums={"fails": fails, "resets": resets})
    # failures seen when the island's reset came: the fewest in the island; none before the first reset
    base = counted.groupBy("run_id", "resets").agg(F.min("fails").alias("least"))
    base = base.withColumn("least", F.when(F.col("resets") == 0, 0).otherwise(F.col("least")))
    stops = counted.where(~F.col("can_connect_smtp")).join(base, ["run_id", "resets"]).where(F.col("fails") - F.col("least") == k)
    return stops.groupBy("run_id").agg(F.min("position").alias("stops_at"))


def verification_summary(outcomes: DataFrame, skipped: DataFrame) -> DataFrame:
    counts = outcomes.agg(
        F.count("*").alias("checked"), *[F.count_if(F.col("status") == s).alias(s) for s in ("deliverable", "undeliverable", "risky", "unknown")],
        F.count_if(F.col("status").isin("risky", "unknown")).alias("needs_review"))
    return counts.withColumn("skipped", skipped.agg(F.count("*")).scalar())
