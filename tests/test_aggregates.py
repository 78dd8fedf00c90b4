from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import aggregates, filters, joins
from gleanery.operators.lookup import fits_broadcast, lookup_join

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def run(spark):
    """Source `hot` holds most fetches; `none` was never fetched."""
    rows = [
        (i, "hot" if i % 10 else f"s{i % 3}", "HTTP error: 500" if i % 7 == 0 else None, at(i), at(i + 1 + i % 5))
        for i in range(200)
    ]
    fetches = spark.createDataFrame(
        rows, "page_id bigint, source_id string, error string, submitted_at timestamp, fetched_at timestamp"
    )
    parses = fetches.filter("error is null").select(
        "page_id", "source_id", F.when(F.col("page_id") % 11 == 0, "bad").alias("error"), F.lit(1).alias("n_items")
    )
    names = [("hot", "Hot"), ("s0", "S0"), ("s1", "S1"), ("s2", "S2"), ("none", "None")]
    return spark.createDataFrame(names, "source_id string, name string"), fetches, parses, rows


def test_run_and_source_stats(run):
    sources, fetches, parses, rows = run
    stats = aggregates.run_stats(sources, fetches, parses).collect()
    assert len(stats) == 1
    failed = sum(r[2] is not None for r in rows)
    ok = [r for r in rows if r[2] is None]
    bad = sum(r[0] % 11 == 0 for r in ok)
    s = stats[0]
    assert (s.total_sources, s.processed_sources) == (5, 200)
    assert (s.successful_fetches, s.failed_fetches) == (200 - failed, failed)
    assert (s.successful_parses, s.failed_parses) == (len(ok) - bad, bad)
    assert (s.start_time, s.end_time) == (at(0), max(r[4] for r in rows))
    per_source = aggregates.source_stats(fetches, parses).collect()
    assert sum(r.processed_sources for r in per_source) == 200 and len(per_source) == 4


def test_empty_run(run):
    sources, fetches, parses, _ = run
    s = aggregates.run_stats(sources.limit(0), fetches.limit(0), parses.limit(0)).first()
    assert (s.total_sources, s.processed_sources, s.failed_parses, s.start_time) == (0, 0, 0, None)


@pytest.mark.parametrize("part_size", [7, 1000])
def test_aggregated_results_keep_every_item(spark, run, part_size):
    _, fetches, _, rows = run
    items = fetches.filter("error is null").select(
        "source_id", F.sha2(F.col("page_id").cast("string"), 256).alias("id"), "page_id",
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"),
    )
    result = aggregates.aggregate_results(items, fetches, START, part_size).collect()
    packed = [(r.source_id, i.page_id) for r in result for i in r["items"]]
    assert sorted(packed) == sorted((r[1], r[0]) for r in rows if r[2] is None)
    hot = [r for r in result if r.source_id == "hot"]
    assert len(hot) == hot[0].part_count == (-(-154 // part_size) if part_size == 7 else 1)
    took = sum(1000 * (1 + r[0] % 5) for r in rows if r[1] == "hot")
    assert {r.total_fetch_time_ms for r in hot} == {took}
    for r in result:
        assert [i.id for i in r["items"]] == sorted(i.id for i in r["items"])


def test_rollup_and_summary(spark, run):
    _, fetches, _, rows = run
    outcomes = fetches.withColumn("content", F.when(F.col("error").isNull(), F.concat(F.lit("c"), "page_id")))
    rolled = aggregates.result_rollup(outcomes, part_size=10)
    found = rolled.collect()
    assert sorted(c for r in found for c in r.contents) == sorted(f"c{r[0]}" for r in rows if r[2] is None)
    assert sum(len(r.errors) for r in found) == sum(r[2] is not None for r in rows)
    summary = aggregates.result_summary(rolled)
    assert summary.columns == ["Content", "Error Count"]
    assert sum(r["Error Count"] for r in summary.collect()) == sum(r[2] is not None for r in rows)
    only_errors = spark.createDataFrame([(["e"],)], "errors array<string>").withColumn(
        "contents", F.array().cast("array<string>")
    )
    assert tuple(aggregates.result_summary(only_errors).first()) == ("", 1)


def test_latency(run):
    _, fetches, _, rows = run
    found = {r.source_id: r for r in aggregates.fetch_latency(fetches).collect()}
    took = sorted(1000 * (1 + r[0] % 5) for r in rows if r[1] == "hot")
    hot = found["hot"]
    assert (hot.fetches, hot.total_ms) == (len(took), sum(took))
    assert hot.mean_ms == sum(took) / len(took)
    middle = (len(took) - 1) / 2
    assert hot.p50_ms == (took[int(middle)] + took[int(middle + 0.5)]) / 2


def test_outcomes_and_sources(run):
    sources, fetches, parses, rows = run
    found = joins.source_outcomes(sources, fetches, parses).collect()
    assert len(found) == 201
    assert [(r.fetch_status, r.parse_status, r.page_id) for r in found if r.source_id == "none"] == [("none", "none", None)]
    assert sum(r.fetch_status == "failed" for r in found) == sum(r[2] is not None for r in rows)
    live = {r.source_id for r in joins.live_sources(sources, fetches).collect()}
    dead = {r.source_id for r in joins.failed_sources(sources, fetches).collect()}
    assert live == {"hot", "s0", "s1", "s2"} and dead == {"none"}


def test_lookup_join_both_ways(spark):
    rows = spark.range(1000).select((F.col("id") % 5).alias("k"), "id")
    table = spark.range(4).select(F.col("id").alias("k"), F.lit("x" * 100).alias("v"))
    assert fits_broadcast(table) and not fits_broadcast(table, max_rows=3)
    assert not fits_broadcast(table, max_bytes=100)
    for how, n in (("inner", 800), ("left", 1000)):
        small = lookup_join(rows, table, "k", how)
        large = lookup_join(rows, table, "k", how, max_rows=3)
        assert "BroadcastHashJoin" in plan(small) and "ShuffledHashJoin" in plan(large)
        assert small.count() == large.count() == n
        assert sorted(small.collect()) == sorted(large.collect()) if how == "inner" else True


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_union(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(1,)], "id int")
    assert sorted(aggregates.union_items(a, a, b).collect(), key=str) == sorted(
        [(1, "x"), (1, "x"), (1, None)], key=str
    )


def test_filters(spark):
    rows = spark.createDataFrame(
        [(1, "Golang news", "x", at(0)), (2, None, "a PROGRAMMING tale", at(10)), (3, "golang", "Sponsored", at(20)), (4, "other", None, None)],
        "id int, title string, content string, date timestamp",
    )
    assert [r.id for r in filters.filter_keywords(rows).collect()] == [1, 2, 3, 4]
    words = filters.INCLUDE_WORDS, filters.EXCLUDE_WORDS
    assert [r.id for r in filters.filter_keywords(rows, *words).collect()] == [1, 2]
    assert [r.id for r in filters.filter_keywords(rows, [], ["x"]).collect()] == [2, 3, 4]
    assert [r.id for r in filters.filter_keywords(rows, ["golang"], []).collect()] == [1, 3]
    assert [r.id for r in filters.filter_date(rows, at(10), at(20)).collect()] == [2]
    assert [r.id for r in filters.filter_date(rows, "", None).collect()] == [1, 2, 3, 4]
