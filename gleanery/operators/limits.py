"""Request rates, politeness and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.functions.urls import url_host
from gleanery.operators.lookup import lookup_join
from gleanery.operators.slices import (
    HOT_ROWS,
    carry_over,
    earlier_slices,
    slice_hot_keys,
    slice_window,
)

DEFAULT_RPM = 30
DEFAULT_DELAY_MS = 200

# Phrases of errors worth another attempt, and the retry policy.
RETRYABLE_ERRORS = ("timeout", "connection refused", "temporary failure")
RETRY_POLICY = {"max_retries": 3, "initial_ms": 100, "max_ms": 5000, "factor": 2.0}


def host_limits(sources: DataFrame) -> DataFrame:
    """(host, rpm) of the first source of each host with a positive limit."""
    return (
        sources.filter(F.col("rpm") > 0)
        .withColumn("host", url_host(F.col("url")))
        .groupBy("host")
        .agg(F.min_by("rpm", "pos").alias("rpm"))
    )


def domain_rate_limit(
    urls: DataFrame, sources: DataFrame, default: int = DEFAULT_RPM
) -> DataFrame:
    """Add `rpm` to rows with a `host`."""
    limited = lookup_join(urls, host_limits(sources), "host", "left")
    return limited.withColumn("rpm", F.coalesce("rpm", F.lit(default)))


def token_bucket_schedule(
    requests: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str | tuple[str, ...] = "id",
    rpm: str = "rpm",
    capacity: Column | int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `release_ts` and `wait_ms`: when each request gets its token.

    The bucket starts full, refills continuously and serves in (ts, *tie) order. A rate
    that is null or not positive is the default one. With
    T the time of one token, request k is released at
    max(t_k, max over j<k of (t_j - j*T) + k*T - (capacity-1)*T), a running maximum,
    so no sequential replay is needed.
    """
    ties = (tie,) if isinstance(tie, str) else tuple(tie)
    rate = F.when(F.col(rpm) > 0, F.col(rpm)).otherwise(F.lit(DEFAULT_RPM)).cast("bigint")
    cap = rate if capacity is None else F.lit(capacity) if isinstance(capacity, int) else capacity
    rows = (
        slice_hot_keys(requests, key, ts, ties, hot_rows)
        .withColumn("_t", F.unix_micros(ts))
        .withColumn("_token", F.floor(F.lit(60_000_000) / rate))
        .withColumn("_cap", cap.cast("bigint"))
    )
    window = slice_window(key, "_t", *ties)
    rows = rows.withColumn("_k", F.row_number().over(window).cast("bigint"))
    debt = F.col("_t") - F.col("_k") * F.col("_token")
    rows = rows.withColumn("_debt", debt).withColumn(
        "_before", F.max("_debt").over(window.rowsBetween(Window.unboundedPreceding, -1))
    )
    before = earlier_slices(key)
    rows = carry_over(
        rows,
        key,
        summary={
            "_n": F.count("*"),
            "_top": F.max("_debt"),
            "_slice_token": F.max("_token"),
        },
        carried={
            "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_carry": F.max(F.col("_top") - F.col("_offset") * F.col("_slice_token")).over(before),
        },
    )
    offset = F.coalesce("_offset", F.lit(0))
    running = F.greatest(F.col("_carry"), F.col("_before") - offset * F.col("_token"))
    number = F.col("_k") + offset
    release = F.greatest(
        F.col("_t"), running + number * F.col("_token") - (F.col("_cap") - 1) * F.col("_token")
    )
    return (
        rows.withColumn("release_ts", F.timestamp_micros(release))
        .withColumn("wait_ms", F.floor((F.unix_micros("release_ts") - F.col("_t")) / 1000))
        .select(*requests.columns, "release_ts", "wait_ms")
    )


def rate_audit(requests: DataFrame, limits: DataFrame, default: int = DEFAULT_RPM) -> DataFrame:
    """(host, minute) cells with more requests than the host's limit.

    Requests are counted before the join, so the join sees cells, not requests.
    """
    cells = requests.groupBy("host", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count("*").alias("n")
    )
    return (
        cells.join(limits, "host", "left")
        .withColumn("rpm", F.coalesce("rpm", F.lit(default)))
        .filter("n > rpm")
        .select("host", "minute", "n", "rpm")
    )


def crawl_delay_audit(
    requests: DataFrame,
    delays: DataFrame,
    default_ms: int = DEFAULT_DELAY_MS,
    tie: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Requests that follow the previous one to the host too soon.

    `delays` has (host, delay_s); hosts without one use the default delay.
    """
    window = slice_window("host", "ts", tie)
    rows = slice_hot_keys(requests, "host", "ts", tie, hot_rows).withColumn(
        "_previous", F.lag("ts").over(window)
    )
    rows = carry_over(
        rows,
        "host",
        summary={"_last": F.max("ts")},
        carried={"_carry": F.max("_last").over(earlier_slices("host"))},
    )
    gap = F.unix_micros("ts") - F.unix_micros(F.coalesce("_previous", "_carry"))
    wanted = F.coalesce(F.col("delay_s").cast("bigint") * 1000, F.lit(default_ms).cast("bigint"))
    return (
        lookup_join(rows, delays, "host", "left")
        .select(*requests.columns, gap.alias("gap_us"), wanted.alias("delay_ms"))
        .filter("gap_us < delay_ms * 1000")
    )


def is_retryable(error: Column, phrases: tuple[str, ...] = RETRYABLE_ERRORS) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(F.lower(error), F.lit(phrase))
    return found


def retry_schedule(
    attempts: DataFrame,
    policy: dict | None = None,
    key: str = "url",
    tie: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the failed attempts of each URL and plan the next one.

    Input: key, ts, tie, error. Adds retryable, attempt, give_up, delay_ms and
    next_at; the last two are null where no further attempt follows.
    """
    rule = {**RETRY_POLICY, **(policy or {})}
    failed = attempts.filter(F.col("error").isNotNull())
    rows = slice_hot_keys(failed, key, "ts", tie, hot_rows).withColumn(
        "_k", F.row_number().over(slice_window(key, "ts", tie)).cast("bigint")
    )
    rows = carry_over(
        rows,
        key,
        summary={"_n": F.count("*")},
        carried={"_offset": F.sum("_n").over(earlier_slices(key))},
    )
    attempt = F.col("_k") + F.coalesce("_offset", F.lit(0))
    grown = F.lit(float(rule["initial_ms"])) * F.pow(F.lit(float(rule["factor"])), F.col("attempt") - 1)
    delay = F.least(grown, F.lit(float(rule["max_ms"]))).cast("bigint")
    return (
        rows.withColumn("attempt", attempt)
        .withColumn("retryable", is_retryable(F.col("error")))
        .withColumn("give_up", ~F.col("retryable") | (F.col("attempt") >= rule["max_retries"]))
        .withColumn("delay_ms", F.when(~F.col("give_up"), delay))
        .withColumn(
            "next_at", F.timestamp_micros(F.unix_micros("ts") + F.col("delay_ms") * 1000)
        )
        .select(*attempts.columns, "retryable", "attempt", "give_up", "delay_ms", "next_at")
    )
