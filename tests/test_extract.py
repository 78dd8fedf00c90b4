import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions.registry import Registry
from gleanery.operators import extract, fetches, normalize
from gleanery.schemas import SOURCES

NESTED = """<div class="item x"><h3>One</h3><a href="/1">l</a>
<div class="item"><h3>Inner</h3></div><p>tail</p></div>
<div class=other><h3>No</h3></div>
<div class="item"><h3>Two &amp; more<p>open<div>deep</div><script>"<h3>js</h3>"</script></div>
<div class="item"><a class="u" href="">e</a><a href="/3">x</a></div>"""


def test_nested_containers(spark):
    pages = spark.createDataFrame([(7, NESTED), (8, None), (9, "<p>none</p>")], "page_id bigint, html string")
    found = extract.extract_html_items(pages, "div.item", {"title": "h3", "url": "a", "content": "p"})
    rows = [(r.page_id, r.item_no, r.title, r.url) for r in found.orderBy("page_id", "item_no").collect()]
    assert rows == [
        (7, 0, "One", "/1"),
        (7, 1, "Inner", None),
        (7, 2, "Two & moreopendeep", None),
        (7, 3, None, "/3"),
    ]


def sources(spark, *rows):
    names = spark.createDataFrame([], SOURCES).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCES)


@pytest.fixture
def registry_rows(spark):
    return sources(
        spark,
        {"source_id": "h", "name": "H", "url": "https://h/", "parser": "html", "type": "html",
         "selectors": {"container": "article", "title": ".t, h2", "url": "a", "price": ".p"}},
        {"source_id": "j", "name": "J", "parser": "json", "mappings": {"container": "data.rows", "title": "name", "price": "cost"}},
        {"source_id": "l", "name": "L", "parser": "json", "mappings": {"title": "name"}},
        {"source_id": "x", "name": "X", "type": "xml", "mappings": {"title": "n", "url": "u"}},
        {"source_id": "r", "name": "R", "parser": "rss", "mappings": {"title": "title", "date": "pubDate"}},
        {"source_id": "p", "name": "P", "parser": "pdf"},
    )


HTML = """<article><h2>A</h2><a href="/a">x</a><i class="p">3</i></article>
<!-- <article><h2>hidden</h2></article> --><article><b class="t"> </b><h2>B</h2></article>"""
JSON = json.dumps({"data": {"rows": [{"name": "one", "cost": 1.5, "deep": {"k": [1]}}, {"name": None}]}})
XML = "<list><item><n> A &lt; B </n><u>/x</u></item><other/><item><n>C</n></item></list>"
RSS = "<rss><channel><title>f</title><item><title>T</title><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>"

JOBS = [
    (1, "h", "https://h/p", HTML, None),
    (2, "j", "https://j/p", JSON, None),
    (3, "j", "https://j/q", "{broken", None),
    (4, "l", "https://l/p", '[{"name": "bare"}]', None),
    (5, "x", "https://x/p", XML, None),
    (6, "x", "https://x/q", "<list><item>", None),
    (7, "r", "https://r/p", RSS, None),
    (8, "p", "https://p/p", "%PDF", None),
    (9, "h", "https://h/q", None, "HTTP error: 500"),
    (10, "j", "https://j/r", '{"data": {"rows": []}}', None),
]


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame(JOBS, "page_id bigint, source_id string, url string, body string, error string")


def test_dispatch(registry_rows, jobs):
    rows = extract.dispatch_extract(jobs, registry_rows).orderBy("page_id", "item_no").collect()
    found = [(r.page_id, r.extracted_by, r.title, r.url, r.extra or {}, r.error) for r in rows]
    assert found == [
        (1, "html", "A", "/a", {"price": "3"}, None),
        (1, "html", "B", "https://h/p", {}, None),
        (2, "json", "one", "https://j/p", {"price": "1.5"}, None),
        (2, "json", None, "https://j/p", {}, None),
        (3, "json", None, "https://j/q", {}, "unreadable body for parser: json"),
        (4, "json", "bare", "https://l/p", {}, None),
        (5, "xml", " A < B ", "/x", {}, None),
        (5, "xml", "C", "https://x/p", {}, None),
        (6, "xml", None, "https://x/q", {}, "unreadable body for parser: xml"),
        (7, "rss", "T", "https://r/p", {}, None),
        (8, "pdf", None, "https://p/p", {}, "no parser available for type: pdf"),
        (9, "html", None, "https://h/q", {}, "HTTP error: 500"),
    ]


def test_parse_results_count_empty_bodies_as_parsed(registry_rows, jobs):
    results = {r.page_id: r for r in extract.parse_results(jobs, registry_rows).collect()}
    assert len(results) == len(JOBS)
    assert results[10].items == [] and results[10].error is None


def test_registered_extractor(registry_rows, jobs):
    known = Registry()
    known.register_extractor("pdf", lambda d: d.select("page_id", F.upper("body").alias("title")))
    found = extract.dispatch_extract(jobs, registry_rows, known)
    assert [r.title for r in found.filter("page_id = 8").collect()] == ["%PDF"]
    assert found.filter("page_id = 2").count() == 2


def test_literal_extractors(spark):
    rows = spark.createDataFrame([(1, JSON)], "id int, body string")
    found = extract.extract_json(rows, {"container": "data.rows", "title": "name", "d": "deep"}).collect()
    assert [(r.item_no, r.title, r.extra) for r in found] == [(0, "one", {"d": '{"k":[1]}'}), (1, None, {})]
    rows = spark.createDataFrame([(1, XML.replace("item", "entry"))], "id int, body string")
    assert extract.extract_xml(rows, {"title": "n"}, "entry").count() == 2
    rows = spark.createDataFrame([(1, RSS), (2, "junk")], "id int, body string")
    assert extract.extract_rss(rows, {"title": "title"}).count() == 1


def test_stamps_and_result_items(spark, registry_rows, jobs):
    items = extract.dispatch_extract(jobs, registry_rows).filter("error is null")
    run_ts = F.timestamp_seconds(F.lit(1_700_000_000))
    stamped = extract.stamp_items(items, registry_rows, run_ts)
    assert {r.source_name for r in stamped.collect()} == {"H", "J", "L", "X", "R"}
    built = normalize.build_result_items(normalize.normalize_items(stamped), run_ts)
    by_page = {(r.content_id, r.title): r for r in built.collect()}
    rss = by_page[("7", "T")]
    assert rss.timestamp.isoformat() == "2024-01-02T03:04:05" and rss.type == "other"
    assert by_page[("1", "A")].metadata == {"price": "3"}
    assert by_page[("5", "A < B")].timestamp == rss.created_at


def test_fetch_predicates(spark):
    rows = spark.createDataFrame(
        [(1, 204, "b"), (2, 301, "b"), (3, None, "b"), (4, 200, None)], "page_id int, status int, body string"
    )
    classified = fetches.classify_fetch(rows)
    errors = {r.page_id: r.error for r in classified.collect()}
    assert errors == {1: None, 2: "HTTP error: 301", 3: "HTTP error: none", 4: None}
    assert [r.page_id for r in fetches.to_parse_jobs(classified).collect()] == [1]


def test_normalize_by_type(spark):
    rows = spark.createDataFrame(
        [(" a ", "text"), ("", "json"), (None, "rss"), (" a ", "pdf"), ("", "pdf")], "content string, content_type string"
    )
    known = Registry()
    found = [tuple(r) for r in normalize.normalize_by_type(rows, known).select("content", "error").collect()]
    none = "no content to normalize"
    assert found == [("a", None), (None, none), (None, none), (" a ", None), ("", None)]
    known.register_normalizer("pdf", F.upper)
    known.register_normalizer("text", F.reverse)
    again = [r.content for r in normalize.normalize_by_type(rows, known).collect()]
    assert again == [" a ", None, None, " A ", None]


def test_records_by_the_containers_of_their_sources(spark):
    jobs = spark.createDataFrame(
        [
            (1, "p", "<all><product id='1'><t>A</t></product><product><t>B</t></product></all>"),
            (2, "i", "<all><item><t>C</t></item></all>"),
            (3, "none", "<all/>"),
        ],
        "page_id long, source_id string, body string",
    )
    sources = spark.createDataFrame(
        [("p", {"title": "t", "container": "product"}), ("i", {"title": "t"})],
        "source_id string, mappings map<string,string>",
    ).selectExpr("source_id", "'xml' AS type", "'xml' AS parser", "CAST(NULL AS map<string,string>) AS selectors", "mappings")
    rows = [(r.page_id, r.title, r.error) for r in extract.dispatch_extract(jobs, sources).collect()]
    assert sorted(rows, key=str) == [
        (1, "A", None), (1, "B", None), (2, "C", None), (3, None, "unknown source: none"),
    ]
