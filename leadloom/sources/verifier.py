"""Verifier responses to outcome columns: verdicts, notes, and what they mean for outreach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import lookup

# The nested response of the address verifier.
RESPONSE_A = ("struct<is_reachable:string,misc:struct<is_disposable:boolean,is_role_account:boolean>,"
              "mx:struct<accepts_mail:boolean,error:struct<message:string>>,"
              "smtp:struct<can_connect_smtp:boolean,has_full_inbox:boolean,is_catch_all:boolean,is_deliverable:boolean,"
              "is_disabled:boolean,error:struct<message:string>>,syntax:struct<is_valid_syntax:boolean>>")
RESPONSE_B = "struct<status:string,regexp:boolean,mx_records:boolean,block:boolean,accept_all:boolean>"

# Verification status of the second provider -> (status, verdict), and notes per verdict.
STATUS_B = {
    "valid": ("deliverable", "deliverable"),
    "invalid": ("undeliverable", "mailbox_not_found"),
    "accept_all": ("risky", "catch_all"),
    "webmail": ("unknown", "webmail"),
    "disposable": ("undeliverable", "disposable"),
    "unknown": ("unknown", "unknown"),
}
NOTES_B = {
    "mailbox_not_found": "Hunter: the mail server says this mailbox does not exist",
    "invalid_syntax": "Hunter: not a valid email address",
    "no_mail_server": "Hunter: the domain has no mail server",
    "catch_all": "Hunter: the domain accepts mail for any address (catch-all); existence cannot be proven",
    "webmail": "Hunter: a webmail address (e.g. gmail.com); Hunter cannot verify these",
    "disposable": "Hunter: a disposable email address",
    "blocked": "Hunter: the mail server blocked the verification",
    "unknown": "Hunter could not verify this address",
    "check_failed": "Hunter did not finish the verification; try again later",
}
# Notes per verdict of the first verifier.
NOTES_A = {
    "invalid_syntax": "invalid syntax",
    "no_mail_server": "domain has no mail server",
    "disabled": "mailbox is disabled",
    "mailbox_not_found": "mail server says this mailbox does not exist",
    "catch_all": "domain accepts mail for any address (catch-all); existence cannot be proven",
    "full_inbox": "mailbox exists but is full",
    "disposable": "disposable email domain",
    "risky": "Reacher rated this address risky (deliverability not certain)",
}
NOTE_UNKNOWN_A = "Reacher could not verify this address (server unreachable, blocked or greylisted)"


def summarize_a(response: Column) -> list[Column]:
    """The eleven columns kept of a response; every one NULL when the check itself failed."""
    error = F.coalesce(F.nullif(response["smtp"]["error"]["message"], F.lit("")), response["mx"]["error"]["message"])
    return [response["is_reachable"].alias("is_reachable"),
            *[response["smtp"][c].alias(c) for c in ("can_connect_smtp", "is_deliverable", "is_catch_all", "has_full_inbox", "is_disabled")],
            error.alias("smtp_error"), response["mx"]["accepts_mail"].alias("accepts_mail"),
            *[response["misc"][c].alias(c) for c in ("is_disposable", "is_role_account")],
            response["syntax"]["is_valid_syntax"].alias("valid_syntax"), response.isNotNull().alias("answered")]


def status_a() -> Column:
    reach = F.col("is_reachable")
    return (F.when(reach == "safe", "deliverable").when(reach == "invalid", "undeliverable").when(reach == "risky", "risky")
            .otherwise("unknown"))


def verdict_a() -> Column:
    invalid = (F.when(~F.col("valid_syntax"), "invalid_syntax").when(~F.col("accepts_mail"), "no_mail_server")
               .when(F.col("is_disabled"), "disabled").otherwise("mailbox_not_found"))
    risky = (F.when(F.col("is_catch_all"), "catch_all").when(F.col("has_full_inbox"), "full_inbox")
             .when(F.col("is_disposable"), "disposable").otherwise("risky"))
    error = F.lower(F.coalesce("smtp_error", F.lit("")))
    unknown = (F.when(~F.col("can_connect_smtp"), "smtp_unreachable").when(error.startswith("permanent"), "blocked")
               .when(error.startswith("transient"), "temporary_failure").otherwise("unknown"))
    reach = F.col("is_reachable")
    return (F.when(~F.col("answered"), "check_failed").when(reach == "safe", "deliverable").when(reach == "invalid", invalid)
            .when(reach == "risky", risky).otherwise(unknown))


def note_a(verdict: Column) -> Column:
    other = F.coalesce(F.nullif("smtp_error", F.lit("")), F.lit(NOTE_UNKNOWN_A))
    return F.when(verdict != "deliverable", F.coalesce(lookup(verdict, NOTES_A), other))


def outcome_a(responses: DataFrame, column: str = "response") -> DataFrame:
    """Response rows with the kept columns, status, verdict, note and whether asking again may help."""
    flat = responses.select(*[c for c in responses.columns if c != column], *summarize_a(F.col(column)))
    flat = flat.withColumns({"status": status_a(), "verdict": verdict_a()})
    permanent = F.coalesce(F.col("smtp_error"), F.lit("")).startswith("permanent")
    return flat.withColumns({"note": note_a(F.col("verdict")), "retryable": (F.col("status") == "unknown") & ~permanent})


def outcome_b(responses: DataFrame, column: str = "response") -> DataFrame:
    """The second provider's responses as the same outcome columns."""
    data = F.col(column)
    name = data["status"]
    status = F.coalesce(lookup(name, {k: s for k, (s, _) in STATUS_B.items()}), F.lit("unknown"))
    verdict = F.coalesce(lookup(name, {k: v for k, (_, v) in STATUS_B.items()}), F.lit("unknown"))
    verdict = (F.when(name.isNull(), "check_failed")
               .when((name == "invalid") & ~F.coalesce(data["regexp"], F.lit(True)), "invalid_syntax")
               .when((name == "invalid") & ~F.coalesce(data["mx_records"], F.lit(True)), "no_mail_server")
               .when((name == "unknown") & F.coalesce(data["block"], F.lit(False)), "blocked").otherwise(verdict))
    note = lookup(F.col("verdict"), NOTES_B)
    rows = responses.withColumns({"status": status, "verdict": verdict, "probed_status": F.coalesce(name, F.lit("unknown")),
                                  "is_catch_all": F.coalesce(data["accept_all"], F.lit(False)) | F.coalesce(name == "accept_all", F.lit(False))})
    return rows.withColumns({"note": note, "retryable": F.col("status") == "unknown"}).drop(column)
