"""robots.txt snapshots as tables, verdicts and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.functions.robots_txt import (
    is_allowed,
    prepared_rules,
    robots_delay_seconds,
    robots_groups,
    robots_sitemap_urls,
    rules_for_agent,
)
from gleanery.functions.urls import request_path, url_host, url_path, url_query
from gleanery.operators.lookup import lookup_join
from gleanery.operators.slices import (
    HOT_ROWS,
    carry_over,
    earlier_slices,
    slice_hot_keys,
    slice_window,
)

DEFAULT_TTL_SECONDS = 24 * 3600


def robots_status_policy(responses: DataFrame) -> DataFrame:
    """(host, status, body, warning): 200 keeps the body, 404 means no rules, any other
    status means no rules and a warning."""
    ok, missing = F.col("status") == 200, F.col("status") == 404
    warning = F.when(
        ~F.coalesce(ok | missing, F.lit(False)),
        F.concat(F.lit("received status code "), F.coalesce(F.col("status").cast("string"), F.lit("none"))),
    )
    return responses.withColumn(
        "body", F.when(ok, F.coalesce("body", F.lit(""))).otherwise(F.lit(""))
    ).withColumn("warning", warning)


def parse_robots(bodies: DataFrame) -> DataFrame:
    """Rule rows (host, agent, path, allow, pos)."""
    groups = bodies.select("host", F.explode(robots_groups(F.col("body"))).alias("g"))
    rules = groups.select("host", F.col("g.agents").alias("agents"), F.explode("g.rules").alias("r"))
    return rules.select(
        "host", F.explode("agents").alias("agent"), F.col("r.path"), F.col("r.allow"), F.col("r.pos")
    )


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    return bodies.select("host", F.explode(robots_sitemap_urls(F.col("body"))).alias("sitemap"))


def robots_crawl_delay(bodies: DataFrame) -> DataFrame:
    return bodies.select("host", robots_delay_seconds(F.col("body")).alias("delay_s"))


def robots_rules(bodies: DataFrame, agent: Column | str) -> DataFrame:
    """(host, rules) that apply to one agent, ready for matching, one row per body."""
    name = F.lit(agent) if isinstance(agent, str) else agent
    rules = rules_for_agent(robots_groups(F.col("body")), name)
    return bodies.select("host", prepared_rules(rules).alias("rules"))


def robots_allowed(urls: DataFrame, bodies: DataFrame, agent: str) -> DataFrame:
    """Add `allowed` to each row with a `url`.

    `bodies` has one robots body per host. Its rules travel as one array, so the join
    is one row to one host and no (URL, rule) pairs are made.
    """
    url = F.col("url")
    requests = urls.withColumn("_host", url_host(url))
    rules = robots_rules(bodies, agent).withColumnRenamed("host", "_host")
    verdict = is_allowed(F.col("rules"), request_path(url_path(url), url_query(url)))
    return lookup_join(requests, rules, "_host", "left").select(
        *urls.columns, F.coalesce(verdict, F.lit(True)).alias("allowed")
    )


def robots_blocked(urls: DataFrame, bodies: DataFrame, agent: str) -> DataFrame:
    return robots_allowed(urls, bodies, agent).filter(~F.col("allowed")).drop("allowed")


def robots_asof(
    requests: DataFrame,
    snapshots: DataFrame,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    tie: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The newest snapshot of the host that has not expired when the request is made.

    `requests` has host, ts and a numeric tie; `snapshots` has host, fetched_at and
    version. Both are laid on one time line per host and the last snapshot is
    carried forward, so no (request, snapshot) pairs are made.
    """
    timeline = requests.select(
        "host",
        "ts",
        F.lit(True).alias("_is_request"),
        F.col(tie).cast("bigint").alias("_tie"),
        F.struct(*requests.columns).alias("_request"),
        F.lit(None).cast("struct<fetched_at: timestamp, version: bigint>").alias("_snapshot"),
    ).unionByName(
        snapshots.select(
            "host",
            F.col("fetched_at").alias("ts"),
            # Snapshots come before requests of the same time, newer versions last.
            F.lit(False).alias("_is_request"),
            F.col("version").cast("bigint").alias("_tie"),
            F.lit(None).cast(requests.select(F.struct(*requests.columns)).schema[0].dataType).alias("_request"),
            F.struct("fetched_at", F.col("version").cast("bigint").alias("version")).alias("_snapshot"),
        )
    )
    rows = slice_hot_keys(timeline, "host", "ts", ("_is_request", "_tie"), hot_rows)
    window = slice_window("host", "ts", "_is_request", "_tie")
    rows = rows.withColumn(
        "_seen",
        F.last("_snapshot", ignorenulls=True).over(
            window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    rows = carry_over(
        rows,
        "host",
        summary={"_newest": F.max("_snapshot")},
        carried={"_carry": F.max("_newest").over(earlier_slices("host"))},
    )
    found = F.coalesce("_seen", "_carry")
    fresh = F.col("ts") < found["fetched_at"] + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return rows.filter(F.col("_request").isNotNull()).select(
        "_request.*",
        F.when(fresh, found["fetched_at"]).alias("robots_fetched_at"),
        F.when(fresh, found["version"]).alias("robots_version"),
    )
