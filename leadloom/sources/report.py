"""Report and log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_COLUMNS = ("contact_id", "business_id", "email", "status", "verdict", "probed", "catch_all", "role_account", "note")


def report_rows(outcomes: DataFrame) -> DataFrame:
    """The nine report columns of a verification run."""
    return outcomes.select("contact_id", "business_id", F.col("address").alias("email"), "status", "verdict", "probed",
                           F.col("is_catch_all").alias("catch_all"), F.col("is_role_account").alias("role_account"),
                           F.coalesce("note", F.lit("")).alias("note"))


REPORT_SCHEMA = "contact_id long, business_id long, email string, status string, verdict string, probed boolean, catch_all boolean, role_account boolean, note string"


def write_report(outcomes: DataFrame, path: str) -> None:
    """The report in order of business and contact, as CSV with a header, through Spark's commit protocol.

    Files are ranges of that order and their names follow it, so they are one report when read by name; a small run is one file. Texts are quoted
    where they hold a comma, a quote or a line break.
    """
    rows = report_rows(outcomes).orderBy("business_id", "contact_id", "email")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A written report, with types; a note is never NULL."""
    rows = spark.read.schema(REPORT_SCHEMA).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path)
    return rows.withColumn("note", F.coalesce("note", F.lit("")))


def usage_log(calls: DataFrame, path: str | None = None) -> DataFrame:
    """Billable calls as usage records: default action ``other``, long texts cut, missing counts zero; appended when a path is given."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "credits") if c in calls.columns}
    rows = calls.withColumns({**zero, "action": F.coalesce("action", F.lit("other")), "model": F.left(F.coalesce("model", F.lit("")), F.lit(100)),
                              "detail": F.left(F.coalesce("detail", F.lit("")), F.lit(255))})
    if path:
        rows.write.mode("append").parquet(path)
    return rows
