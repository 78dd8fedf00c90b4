"""Sources and outcomes joined to fetches and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.operators.lookup import lookup_join


def enrich_with_source(records: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Source attributes on each fetch or item."""
    return lookup_join(records, sources, key)


def source_outcomes(sources: DataFrame, fetches: DataFrame, parses: DataFrame) -> DataFrame:
    """Every source with its fetch and parse outcomes; sources without any appear once.

    Fetches meet their parses on the unique page id. They then meet their sources in
    an inner join, where a skewed source can be split; sources without a fetch are
    added by an anti join against the distinct fetched ids.
    """
    outcome = F.when(F.col("error").isNull(), "ok").otherwise("failed")
    parsed = parses.select("page_id", outcome.alias("parse_status"), "n_items")
    fetched = (
        fetches.select("page_id", "source_id", outcome.alias("fetch_status"))
        .join(parsed, "page_id", "left")
        .withColumn("parse_status", F.coalesce("parse_status", F.lit("none")))
    )
    seen = enrich_with_source(fetched, sources.select("source_id", "name"))
    seen_ids = fetches.select("source_id").distinct()
    unseen = sources.select("source_id", "name").join(seen_ids, "source_id", "left_anti").select(
        "source_id",
        "name",
        F.lit("none").alias("fetch_status"),
        F.lit("none").alias("parse_status"),
    )
    return seen.unionByName(unseen, allowMissingColumns=True).select(
        "source_id", "name", "page_id", "fetch_status", "parse_status", "n_items"
    )


def _fetched_ids(fetches: DataFrame) -> DataFrame:
    """Ids with a successful fetch, made distinct before they are shuffled."""
    return fetches.filter(F.col("error").isNull()).select("source_id").distinct()


def live_sources(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    return sources.join(_fetched_ids(fetches), "source_id", "left_semi")


def failed_sources(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    return sources.join(_fetched_ids(fetches), "source_id", "left_anti")
