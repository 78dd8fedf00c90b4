"""The dataflow: from sources to scheduled requests, from fetches to result items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.registry import Registry
from gleanery.functions.selectors import first_match
from gleanery.functions.text import drop_hidden_markup, strip_html, trim_text, truncate_text
from gleanery.functions.urls import url_host
from gleanery.operators.extract import dispatch_extract
from gleanery.operators.fetches import classify_fetch
from gleanery.operators.filters import filter_keywords
from gleanery.operators.limits import domain_rate_limit, token_bucket_schedule
from gleanery.operators.normalize import build_result_items, normalize_items
from gleanery.operators.robots import robots_allowed, robots_status_policy
from gleanery.sources.frontier import paginate
from gleanery.sources.registry import enabled_sources


def crawl_schedule(
    sources: DataFrame, robots_responses: DataFrame, agent: str, start: datetime | Column
) -> DataFrame:
    """When each page of the enabled sources may be requested: (source_id, page, url,
    host, rpm, release_ts, wait_ms).

    `robots_responses` has host, status and body; only a body of status 200 has rules.
    Pages that robots rules forbid are left out for sources that respect them. Requests
    to a host wait for its token bucket, higher priority first, then in source order.
    """
    enabled = enabled_sources(sources)
    pages = paginate(enabled, keep=("respect_robots", "priority", "pos"))
    checked = robots_allowed(pages, robots_status_policy(robots_responses), agent)
    wanted = checked.filter(F.col("allowed") | ~F.coalesce("respect_robots", F.lit(False)))
    limited = domain_rate_limit(wanted.withColumn("host", url_host(F.col("url"))), sources)
    requests = limited.select(
        "source_id",
        "page",
        "url",
        "host",
        "rpm",
        (start if isinstance(start, Column) else F.lit(start)).alias("ts"),
        (-F.coalesce("priority", F.lit(0)).cast("bigint")).alias("_turn"),
        "pos",
    )
    order = ("_turn", "pos", "page")
    return token_bucket_schedule(requests, key="host", tie=order).drop("ts", "_turn", "pos")


def items_with_errors(
    fetches: DataFrame, sources: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """Extracted and normalized items, plus one error row per failed fetch or parse.

    Narrow up to the join with the sources: one pass, in batch and in streams.
    """
    return normalize_items(dispatch_extract(classify_fetch(fetches), sources, registry))


def result_items(
    fetches: DataFrame, sources: DataFrame, run_ts: datetime | Column
) -> DataFrame:
    """Result items of all fetches that could be read."""
    items = items_with_errors(fetches, sources).filter(F.col("error").isNull())
    return build_result_items(items, run_ts)


def host_report(pages: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Pages per host whose title or content passes the keyword filter.

    The whole title and the whole visible text are tested and counted; only the title
    shown is cut.
    """
    read = pages.select(
        url_host(F.col("url")).alias("host"),
        trim_text(first_match("title", drop_hidden_markup(F.col("html")), "h1, title")).alias("title"),
        strip_html(F.col("html")).alias("content"),
    )
    kept = filter_keywords(read, include, exclude)
    return kept.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.sum(F.length("content")).alias("content_chars"),
        F.max(truncate_text(F.col("title"), 100)).alias("last_title"),
    )
