"""Predicates on fetch records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def classify_fetch(fetches: DataFrame) -> DataFrame:
    """Set `error`: an earlier error is kept, a status outside 200-299 becomes one."""
    bad_status = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    status_error = F.when(
        bad_status, F.concat(F.lit("HTTP error: "), F.coalesce(F.col("status").cast("string"), F.lit("none")))
    )
    earlier = F.col("error") if "error" in fetches.columns else F.lit(None).cast("string")
    return fetches.withColumn("error", F.coalesce(earlier, status_error))


def to_parse_jobs(fetches: DataFrame) -> DataFrame:
    """Fetches without error and with a body."""
    return fetches.filter(F.col("error").isNull() & F.col("body").isNotNull())
