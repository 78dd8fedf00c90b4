"""Nested containers, nested records and large files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleanery.functions.registry import Registry
from gleanery.operators import extract
from gleanery.schemas import SOURCES
from gleanery.sources.fetches import scan_dump_records, scan_xml


def sources(spark, *rows):
    names = spark.createDataFrame([], SOURCES).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCES)


def jobs(spark, *rows):
    return spark.createDataFrame(rows, "page_id bigint, source_id string, url string, body string, error string")


PAGE = """<main><div class="post"><h2>One</h2><div><p>a <b>b</b></p></div>
<div class="post"><h2>Two &mdash; in</h2><a href="/2">x</a></div><p>tail</p><a href="/1">y</a></div>
<div class="post"><h2> </h2><h3>Three</h3><script>"<h2>no</h2>"</script></div></main><div class="post"><h2>out</h2></div>"""


def test_nested_containers_are_dispatched(spark):
    rules = sources(
        spark,
        {"source_id": "n", "parser": "html", "selectors": {"container": "main div.post", "title": "h2, h3", "url": "a", "content": "div > p", "author": ""}},
        {"source_id": "bad", "parser": "html", "selectors": {"title": "h2:hover"}},
        {"source_id": "leaf", "parser": "html", "selectors": {"title": "h3"}},
    )
    fetched = jobs(
        spark, (1, "n", "u", PAGE, None), (2, "bad", "u", PAGE, None), (3, "leaf", "u", PAGE, None), (4, "n", "u", "<p>none</p>", None),
        (5, "n", "u", None, None), (6, "bad", "u", PAGE, "HTTP error: 500"),
    )
    found = extract.dispatch_extract(fetched, rules).orderBy("page_id", "item_no").collect()
    assert [(r.page_id, r.item_no, r.title, r.url, r.content, r.error) for r in found] == [
        (1, 0, "One", "/1", "a <b>b</b>", None),
        (1, 1, "Two — in", "/2", None, None),
        (1, 2, "Three", "u", None, None),
        (2, 0, None, "u", None, "unreadable selector: h2:hover"),
        (3, 0, "Three", "u", None, None),
        (5, 0, None, "u", None, "unreadable body for parser: html"),
        (6, 0, None, "u", None, "HTTP error: 500"),
    ]


def test_leaf_rules_need_no_python(spark):
    rules = sources(spark, {"source_id": "leaf", "parser": "html", "selectors": {"title": "h3, .x@title"}})
    plan = extract.dispatch_extract(jobs(spark, (3, "leaf", "u", PAGE, None)), rules)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_literal_selectors_with_combinators(spark):
    pages = spark.createDataFrame([(2**60 + 1, PAGE), (None, PAGE), (2**60 + 3, None)], "page_id bigint, html string")
    found = extract.extract_html(pages, {"title": "main > div:nth-child(2) > h3", "url": "div div a"}).collect()
    assert {(r.page_id, r.title, r.url) for r in found} == {
        (2**60 + 1, "Three", "/2"), (None, "Three", "/2"), (2**60 + 3, None, None)
    }
    lists = extract.extract_multi(pages, {"tags": "main h2", "links": "main > div a"}).first()
    assert (lists.tags, lists.links) == (["One", "Two — in"], ["/2", "/1"])
    with pytest.raises(ValueError, match="unreadable selector: h1::text"):
        extract.extract_html(pages, {"title": "h1::text"})


def test_large_ids_beside_null(spark):
    rows = [(2**60 + k, "<li>x</li><li>y</li>") for k in range(5)] + [(None, "<li>z</li>")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1)
    found = extract.extract_html_items(pages, "li", {"title": "b"}).collect()
    assert [r.page_id for r in found] == [i for k in range(5) for i in [2**60 + k] * 2] + [None]


RECORDS = [{"name": {"first": "a", "last.name": "b"}, "tags": ["x", "y"], "price": 1.5, "a.b": "dotted"}, {"name": None, "tags": []}]
PATHS = {"container": "data.rows", "title": "name.first", "author": "name['last.name']", "category": "tags[1]", "p": "price", "d": "a.b", "all": "name", "odd": "what? no"}


@pytest.mark.parametrize(
    "rows, want",
    [
        (RECORDS, [("a", "b", "y", {"p": "1.5", "d": "dotted", "all": '{"first":"a","last.name":"b"}'}), (None, None, None, {})]),
        ([7, RECORDS[0], "x", None, [1]], [("a", "b", "y", {"p": "1.5", "d": "dotted", "all": '{"first":"a","last.name":"b"}'})]),
        (RECORDS[1], [(None, None, None, {})]),
        ([], []),
    ],
)
def test_json_paths(spark, rows, want):
    bodies = spark.createDataFrame([(1, json.dumps({"data": {"rows": rows}}))], "id int, body string")
    found = extract.extract_json(bodies, PATHS).collect()
    assert [(r.title, r.author, r.category, r.extra) for r in found] == want


def test_json_shapes_under_plain_keys(spark):
    rules = sources(spark, {"source_id": "j", "parser": "json", "mappings": {"container": "rows", "title": "n"}})
    bodies = ['{"rows": [{"n": "1.50"}, {"n": 2}]}', '{"rows": {"n": "one"}}', '{"rows": [3, {"n": "x"}]}', '{"rows": 5}', '{"no": 1}', "junk", '{"rows": []}']
    fetched = jobs(spark, *((k, "j", "u", b, None) for k, b in enumerate(bodies)))
    found = extract.dispatch_extract(fetched, rules).orderBy("page_id", "item_no").collect()
    bad = "unreadable body for parser: json"
    assert [(r.page_id, r.title, r.error) for r in found] == [
        (0, "1.50", None), (0, "2", None), (1, "one", None), (2, "x", None), (3, None, bad), (4, None, bad), (5, None, bad)
    ]


def test_readers_share_the_pass(spark):
    known = Registry()
    known.register_reader("csv", lambda body, mappings: F.transform(F.split(body, "\n"), lambda l: F.create_map(F.lit("c"), F.split(l, ",")[0])))
    known.register_reader("json", lambda body, mappings: F.array(F.create_map(F.lit("n"), F.upper(body))))
    rules = sources(
        spark, {"source_id": "c", "parser": "csv", "mappings": {"title": "c"}}, {"source_id": "j", "parser": "json", "mappings": {"title": "n"}},
        {"source_id": "x", "parser": "xml", "mappings": {"title": "t"}},
    )
    fetched = jobs(spark, (1, "c", "u", "a,b\nc,d", None), (2, "j", "u", "raw", None), (3, "x", "u", "<r><item><t>T</t></item></r>", None))
    plan = extract.dispatch_extract(fetched, rules, known)
    assert [(r.page_id, r.title) for r in plan.orderBy("page_id", "item_no").collect()] == [(1, "a"), (1, "c"), (2, "RAW"), (3, "T")]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_xml_files_of_many_ranges(spark, tmp_path, small_ranges):
    """A file read by many tasks gives the items of the file read as one body."""
    items = [f"<item id='{k}'><n>name {k} &lt; é{'x' * (k % 37)}</n>\n<u>/{k}</u></item>" for k in range(400)]
    items[7:7] = ["<item/>", "<item a='1'/>", "<other><n>no</n></other>", "<itemised><n>no</n></itemised>"]
    text = "<?xml version='1.0'?>\n<list xmlns='urn:x'>\n" + "\n".join(items) + "\n<item/></list>\n"
    path = str(tmp_path / "big.xml")
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    mappings = {"title": "n", "url": "u"}
    pieces = scan_xml(spark, path)
    assert pieces.rdd.getNumPartitions() > 20
    found = extract.extract_xml(pieces, mappings).orderBy("block", "nth", "item_no").collect()
    whole = spark.createDataFrame([(1, text)], "id int, body string")
    want = extract.extract_xml(whole, mappings).orderBy("item_no").collect()
    assert [(r.title, r.url) for r in found] == [(r.title, r.url) for r in want] and len(want) == 403


def test_dumps_of_many_ranges(spark, tmp_path, small_ranges):
    records = [f"WARC é{k} " + "line\n" * (k % 50) for k in range(300)]
    path = tmp_path / "a.dump"
    path.write_text("\x1e--\n".join(records) + "\x1e--\n\x1e--\nlast", encoding="utf-8")
    found = scan_dump_records(spark, str(path), "\x1e--\n")
    assert found.rdd.getNumPartitions() > 20
    assert [r.body for r in found.orderBy("block", "nth").collect()] == [*records, "last"]
    assert {os.path.basename(r.file) for r in found.select("file").distinct().collect()} == {"a.dump"}
