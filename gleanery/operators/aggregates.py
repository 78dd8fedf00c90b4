"""Run statistics and aggregated results.

Everything is counted in partial aggregates before the shuffle. Lists of a source
are never gathered whole: they are packed into parts of about `part_size` values,
so a source may hold any share of the rows.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.lookup import lookup_join
from gleanery.session import written

PART_SIZE = 1000

COUNTERS = ("successful_fetches", "failed_fetches", "successful_parses", "failed_parses")


def union_items(*frames: DataFrame) -> DataFrame:
    """Append items to items; duplicates are kept, missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))


def outcome_rows(fetches: DataFrame, parses: DataFrame) -> DataFrame:
    """Fetches and parses as one table of 0/1 counters, to be summed in one pass."""
    ok, failed = F.col("error").isNull(), F.col("error").isNotNull()
    zero = F.lit(0).cast("bigint")
    fetched = fetches.select(
        "source_id",
        _flag(ok).alias("successful_fetches"),
        _flag(failed).alias("failed_fetches"),
        zero.alias("successful_parses"),
        zero.alias("failed_parses"),
        F.col("submitted_at").alias("start_time"),
        F.col("fetched_at").alias("end_time"),
    )
    parsed = parses.select(
        "source_id",
        zero.alias("successful_fetches"),
        zero.alias("failed_fetches"),
        _flag(ok).alias("successful_parses"),
        _flag(failed).alias("failed_parses"),
        F.lit(None).cast("timestamp").alias("start_time"),
        F.col("parsed_at").alias("end_time")
        if "parsed_at" in parses.columns
        else F.lit(None).cast("timestamp").alias("end_time"),
    )
    return fetched.unionByName(parsed)


def outcome_totals() -> list[Column]:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]
    processed = F.coalesce(F.sum(F.col("successful_fetches") + F.col("failed_fetches")), F.lit(0))
    return [
        processed.cast("bigint").alias("processed_sources"),
        *sums,
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
    ]


def run_stats(sources: DataFrame, fetches: DataFrame, parses: DataFrame) -> DataFrame:
    """One row of counters over a whole run."""
    return total_stats(sources, outcome_rows(fetches, parses))


def total_stats(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The counters of a run from any rows that hold counters, start and end."""
    registered = sources.select(
        *(F.lit(0).cast("bigint").alias(c) for c in COUNTERS),
        F.lit(None).cast("timestamp").alias("start_time"),
        F.lit(None).cast("timestamp").alias("end_time"),
        F.lit(1).cast("bigint").alias("_source"),
    )
    rows = outcomes.select(*COUNTERS, "start_time", "end_time")
    rows = rows.withColumn("_source", F.lit(0).cast("bigint")).unionByName(registered)
    return rows.agg(
        F.coalesce(F.sum("_source"), F.lit(0)).cast("bigint").alias("total_sources"), *outcome_totals()
    )


def source_stats(fetches: DataFrame, parses: DataFrame) -> DataFrame:
    """The same counters per source."""
    return outcome_rows(fetches, parses).groupBy("source_id").agg(*outcome_totals())


def part_number(id_column: Column, parts: Column) -> Column:
    """A stable part of a row, from the digest of its id."""
    digits = F.conv(F.substring(F.md5(id_column.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digits, parts)


def fetch_totals(fetches: DataFrame) -> DataFrame:
    """Per source: fetches that worked and failed, and the milliseconds they took."""
    took = F.unix_millis("fetched_at") - F.unix_millis("submitted_at")
    return fetches.groupBy("source_id").agg(
        F.count_if(F.col("error").isNull()).alias("successful_count"),
        F.count_if(F.col("error").isNotNull()).alias("failed_count"),
        F.coalesce(F.sum(took), F.lit(0)).cast("bigint").alias("total_fetch_time_ms"),
    )


def _by_id(a: Column, b: Column) -> Column:
    # Items hold maps, which have no order of their own.
    return F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)


def aggregate_results(
    items: DataFrame, fetches: DataFrame, run_ts: datetime | Column, part_size: int = PART_SIZE
) -> DataFrame:
    """Items of each source with its fetch statistics.

    One row per (source_id, part): `items` of one part sorted by id, `part_count`
    rows per source, and the statistics repeated on each. A source without items has
    one row with an empty list.
    """
    now = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    counts = items.groupBy("source_id").agg(F.count("*").alias("_n"))
    totals = fetch_totals(fetches).join(counts, "source_id", "full")
    totals = written(
        totals.select(
            "source_id",
            F.coalesce("successful_count", F.lit(0)).alias("successful_count"),
            F.coalesce("failed_count", F.lit(0)).alias("failed_count"),
            F.coalesce("total_fetch_time_ms", F.lit(0)).alias("total_fetch_time_ms"),
            F.greatest(F.ceil(F.coalesce("_n", F.lit(0)) / part_size), F.lit(1)).alias("part_count"),
        ),
        "totals",
    )
    fields = [c for c in items.columns if c != "source_id"]
    rest = [c for c in fields if c != "id"]
    packed = (
        lookup_join(items, totals.select("source_id", "part_count"), "source_id")
        .withColumn("part", part_number(F.col("id"), F.col("part_count")))
        # A join on the source alone must not decide where the parts of a large one go.
        .repartition("source_id", "part")
        .groupBy("source_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("id", *rest)), _by_id).alias("items"))
    )
    # In two steps, so that no row holds a list of all parts of a source.
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("part_count") - 1) / PART_SIZE)))
    within = F.explode(F.sequence(F.lit(0), F.lit(PART_SIZE - 1)))
    slots = (
        totals.withColumn("_block", block)
        .withColumn("_within", within)
        .withColumn("part", F.col("_block") * PART_SIZE + F.col("_within"))
        .filter("part < part_count")
        .drop("_block", "_within")
    )
    empty = F.array().cast(packed.schema["items"].dataType)
    return slots.join(packed, ["source_id", "part"], "left").select(
        F.sha2(F.concat_ws("|", "source_id", F.col("part").cast("string")), 256).alias("id"),
        "source_id",
        "part",
        "part_count",
        F.coalesce("items", empty).alias("items"),
        F.lit(1).alias("source_count"),
        "successful_count",
        "failed_count",
        "total_fetch_time_ms",
        now.alias("created_at"),
    )


def result_rollup(
    outcomes: DataFrame, key: str = "page_id", part_size: int = PART_SIZE
) -> DataFrame:
    """Contents, statistics and errors per source.

    `outcomes` has source_id, key, content and error. One row per (source_id, part);
    contents and errors of a part are sorted by key, and the statistics and the first
    content of the whole source are repeated on each part.
    """
    outcomes = written(outcomes.select("source_id", key, "content", "error"), "outcomes")
    totals = outcomes.groupBy("source_id").agg(
        F.count("*").alias("_n"),
        F.count("content").alias("_contents"),
        F.count("error").alias("_errors"),
        F.min_by("content", F.when(F.col("content").isNotNull(), F.col(key))).alias("_first"),
    )
    part_count = F.ceil(F.col("_n") / part_size).alias("part_count")
    counted = totals.select("source_id", part_count, "_contents", "_errors", "_first")
    counted = written(counted, "counted")
    statistics = F.map_from_arrays(
        F.array(F.lit("contents"), F.lit("errors")), F.array("_contents", "_errors")
    )

    def in_order(name: str) -> Column:
        pairs = F.collect_list(
            F.when(F.col(name).isNotNull(), F.struct(F.col(key).alias("k"), F.col(name).alias("v")))
        )
        return F.transform(F.array_sort(pairs), lambda p: p["v"])

    # The source's totals travel as grouping keys, so they need no second join.
    return (
        lookup_join(outcomes, counted, "source_id")
        .withColumn("part", part_number(F.col(key), F.col("part_count")))
        .repartition("source_id", "part")
        .groupBy("source_id", "part", "part_count", "_contents", "_errors", "_first")
        .agg(in_order("content").alias("contents"), in_order("error").alias("errors"))
        .select(
            "source_id", "part", "part_count", "contents", statistics.alias("statistics"), "errors",
            F.col("_first").alias("first_content"),
        )
    )


def result_summary(results: DataFrame) -> DataFrame:
    """First content (or empty) and number of errors of each result.

    The parts of a rolled-up source are one result, whatever the size of a part.
    """
    if {"source_id", "part", "first_content"} <= set(results.columns):
        per_source = results.groupBy("source_id").agg(
            F.first("first_content").alias("content"),
            F.first(F.col("statistics")["errors"]).alias("n_errors"),
        )
        return per_source.select(
            F.coalesce("content", F.lit("")).alias("Content"),
            F.col("n_errors").cast("int").alias("Error Count"),
        )
    return results.select(
        F.coalesce(F.try_element_at("contents", F.lit(1)), F.lit("")).alias("Content"),
        F.coalesce(F.size("errors"), F.lit(0)).alias("Error Count"),
    )


def fetch_latency(fetches: DataFrame) -> DataFrame:
    """Sum, mean, p50 and p95 of the milliseconds from submission to response.

    Equal latencies of a source are counted first, so the exact percentiles work on
    (latency, frequency) pairs instead of one value per fetch.
    """
    took = (F.unix_millis("fetched_at") - F.unix_millis("submitted_at")).alias("ms")
    frequencies = fetches.select("source_id", took).groupBy("source_id", "ms").agg(
        F.count("*").alias("n")
    )
    total = F.sum(F.col("ms") * F.col("n"))
    return frequencies.groupBy("source_id").agg(
        F.sum(F.when(F.col("ms").isNotNull(), F.col("n"))).alias("fetches"),
        total.alias("total_ms"),
        (total / F.sum(F.when(F.col("ms").isNotNull(), F.col("n")))).alias("mean_ms"),
        F.percentile("ms", F.lit(0.5), F.col("n")).alias("p50_ms"),
        F.percentile("ms", F.lit(0.95), F.col("n")).alias("p95_ms"),
    )
