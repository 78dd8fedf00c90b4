"""Sitemap indexes, keyword tables, and inputs that are computed once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.operators import limits, lookup, robots
from gleanery.operators.filters import filter_keyword_tables, filter_keywords
from gleanery.sources.frontier import sitemap_documents, sitemap_urls

INDEX = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</sitemapindex>'
MAP = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


def index(*urls):
    return INDEX.format("".join(f"<sitemap><loc>\n {u} </loc><lastmod>2024</lastmod></sitemap>" for u in urls))


def sitemap(*urls):
    return MAP.format("".join(f"<url><loc>{u}</loc></url>" for u in urls))


def test_nested_indexes_with_cycles(spark):
    """Five levels, an index that lists itself and its parents, a map that two sources share."""
    documents = {
        "r": index("a", "m0", "r"),
        "a": index("b", "m1", "r", "gone"),
        "b": index("c", "a", "m2"),
        "c": index("m3", "b", "m0", "page"),
        "m0": sitemap("u1", "u2"),
        "m1": sitemap("u3"),
        "m2": sitemap(),
        "m3": sitemap("u4", "u5"),
        "page": "<html/>",
        "far": sitemap("never"),
        "loop1": index("loop2"),
        "loop2": index("loop1"),
        "none": index(),
    }
    pages = spark.createDataFrame(list(documents.items()), "url string, xml string")
    roots = spark.createDataFrame([("s", " r "), ("s", "r"), ("t", "m0"), ("v", "loop1"), ("w", "none"), ("x", "absent")], "source_id string, url string")
    found = sitemap_documents(roots, pages).orderBy("source_id", "doc_pos").collect()
    assert [(r.source_id, r.url, r.error) for r in found] == [
        ("s", "m0", None), ("s", "m1", None), ("s", "gone", "missing sitemap document"), ("s", "m2", None),
        ("s", "m3", None), ("s", "page", "not a sitemap"), ("t", "m0", None), ("w", "none", "not a sitemap"),
        ("x", "absent", "missing sitemap document"),
    ]
    rules = spark.createDataFrame([("s", True, None, 4), ("t", True, None, 1)], "source_id string, process_all boolean, pattern string, max_urls int")
    urls = sitemap_urls(sitemap_documents(roots, pages).where("error is null").join(rules, "source_id"))
    assert sorted((r.source_id, r.url) for r in urls.collect()) == [("s", "u1"), ("s", "u2"), ("s", "u3"), ("s", "u4"), ("t", "u1")]


WORDS = ["go", "Golang", "rust lang", "İstanbul", "x" * 40, "übung", "a.b*c"]


@pytest.fixture
def items(spark):
    rng = random.Random(4)
    parts = [*WORDS, "golan", "GOLANG", "rust", "lang", "Ubung", "ÜBUNG", "abc", "a.b*c!", " "]
    rows = [(k, rng.choice([None, "", *parts]), " ".join(rng.choices(parts, k=rng.randrange(6)))) for k in range(300)]
    return spark.createDataFrame(rows, "id int, title string, content string")


@pytest.mark.parametrize("include, exclude", [(["golang", "RUST LANG"], []), ([], ["go"]), (["go", "x" * 40], ["übung"]), ([], []), ([""], ["A.B*C"]), (["nowhere"], [])])
@pytest.mark.parametrize("keyword_bytes", [1, 1 << 20])
def test_keyword_tables_equal_lists(spark, items, include, exclude, keyword_bytes):
    table = lambda words: spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string")
    found = filter_keyword_tables(items, table(include), table(exclude), keyword_bytes=keyword_bytes)
    assert found.columns == items.columns
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in filter_keywords(items, include, exclude).collect())


def test_ten_thousand_keywords(spark, items):
    """The plan is as large as for two words, and the texts are read once."""
    many = spark.range(10_000).select(F.concat(F.lit("word number "), "id").alias("word")).unionByName(
        spark.createDataFrame([("golang",)], "word string")
    )
    few = spark.createDataFrame([("golang",), ("word number 1",)], "word string")
    plans = [filter_keyword_tables(items, t) for t in (many, few)]
    sizes = [len(p._jdf.queryExecution().optimizedPlan().toString()) for p in plans]
    assert abs(sizes[0] - sizes[1]) < 50
    want = sorted(r.id for r in filter_keywords(items, ["golang"]).collect())
    assert all(sorted(r.id for r in p.collect()) == want for p in plans)


def counted(frame):
    """The frame, and how many of its rows have been computed."""
    seen = frame.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(count, frame.schema), seen


@pytest.fixture
def requests(spark):
    return spark.range(2000).select(
        F.col("id"), F.concat(F.lit("h"), F.col("id") % 7).alias("key"), F.timestamp_seconds(F.col("id") * 3 % 977).alias("ts"),
        F.lit(30).alias("rpm"),
    )


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_inputs_of_sliced_operators_are_computed_once(spark, requests, hot_rows):
    rows, seen = counted(requests)
    assert limits.token_bucket_schedule(rows, hot_rows=hot_rows).count() == 2000
    assert seen.value == 2000
    delays = spark.createDataFrame([("h1", 4)], "key string, delay_s int").withColumnRenamed("key", "host")
    rows, seen = counted(requests.withColumnRenamed("key", "host").select("id", "host", "ts"))
    limits.crawl_delay_audit(rows, delays, hot_rows=hot_rows).collect()
    assert seen.value == 2000
    rows, seen = counted(requests.select("id", F.col("key").alias("url"), "ts", F.lit("timeout").alias("error")))
    limits.retry_schedule(rows, hot_rows=hot_rows).collect()
    assert seen.value == 2000
    snapshots = requests.groupBy(F.col("key").alias("host")).agg(F.min("ts").alias("fetched_at"), F.lit(1).alias("version"))
    rows, seen = counted(requests.withColumnRenamed("key", "host").select("id", "host", "ts"))
    robots.robots_asof(rows, snapshots, 180, hot_rows=hot_rows).collect()
    assert seen.value == 2000


def test_computed_lookups_are_computed_once(spark, requests):
    rows, seen = counted(requests.select("key"))
    table = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert lookup.is_computed(table) and not lookup.is_computed(requests.select("key").where("key > ''"))
    joined = lookup.lookup_join(requests, table, "key")
    assert joined.count() == 2000 and {r.n for r in joined.select("n").distinct().collect()} == {285, 286}
    assert seen.value == 2000
