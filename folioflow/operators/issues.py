"""Issues as rows: totals, the exit code they mean, and their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an issue may say.
ACTIONS = ("retained_original", "skipped_content", "formatting_dropped", "formatting_split", "formatting_expanded", "formatting_repaired")


def issue_errors(issues: DataFrame) -> DataFrame:
    """``(issue_key, error)``: unknown actions, and paragraph numbers on what is no paragraph."""
    checks = F.array(
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown_action"),
        F.when(F.col("paragraph_number").isNotNull() & (F.col("segment_type") != "paragraph"), "paragraph_number"),
        F.when(F.col("page").isNotNull(), "page"),
    )
    return issues.select("issue_key", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("error"))


def totals(issues: DataFrame, *by: str) -> DataFrame:
    """Issues, formatting repairs and skipped content by run or another key, with the exit code: 3 where there is any issue."""
    return issues.groupBy(*by).agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("action").startswith("formatting_")).alias("formatting"), F.count_if(F.col("action") == "skipped_content").alias("skipped"),
        F.when(F.count(F.lit(1)) > 0, 3).otherwise(0).alias("exit_code"),
    )


def log_line(*columns: str) -> Column:
    """An issue as one line of JSON; null fields are left out."""
    return F.to_json(F.struct(*columns))


def write_log(issues: DataFrame, path: str, *columns: str) -> None:
    """The log as JSON lines. An existing log is never overwritten, and tasks that are run again don't double lines."""
    issues.select(log_line(*columns).alias("value")).write.mode("errorifexists").text(path)
