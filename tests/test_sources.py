
import pytest
from pyspark.sql import functions as F

from gleanery.schemas import SOURCES
from gleanery.sources import frontier, registry

YAML = """
sources:
  - id: one
    name: first
    url: "https://one.example/"
    type: html
    enabled: true
    priority: 3
    tags: [news, tech]
    rate_limit: {requests_per_minute: 30, respect_robots_txt: true}
    selectors: {title: "h1, title", categories: [".a", ".b"]}
    headers: {Accept: "text/html"}
    pagination: {enabled: true, start_page: 2, max_pages: 2, param_name: page}
  - id: two
    name: second
    url: "https://two.example/feed"
    type: rss
    mappings: {title: title}
"""


def source(spark, *rows):
    """Rows given as dicts, other columns null."""
    names = spark.createDataFrame([], SOURCES).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCES)


def test_yaml_json_and_parquet(spark, tmp_path):
    (tmp_path / "sources.yaml").write_text(YAML)
    loaded = registry.load_sources(spark, str(tmp_path / "sources.yaml"))
    first, second = loaded.orderBy("pos").collect()
    assert (first.source_id, first.rpm, first.parser, first.tags) == ("one", 30, "html", ["news", "tech"])
    assert first.selectors == {"title": "h1, title", "categories": ".a, .b"}
    assert first.pagination.max_pages == 2 and second.enabled is False
    for kind in ("json", "parquet"):
        path = str(tmp_path / f"sources.{kind}")
        loaded.write.format(kind).save(path)
        again = registry.load_sources(spark, path)
        assert sorted(again.collect(), key=lambda r: r.pos) == [first, second]


def test_validation(spark):
    ok = {"source_id": "a", "name": "n", "url": "u", "type": "html", "selectors": {"title": "h1"}, "pos": 0}
    rows = source(
        spark,
        ok,
        {**ok, "pos": 1},
        {**ok, "source_id": "", "url": "", "name": None, "pos": 2},
        {**ok, "source_id": "b", "type": "pdf", "pos": 3},
        {**ok, "source_id": "c", "selectors": {}, "pos": 4},
        {**ok, "source_id": "d", "type": "rss", "pos": 5},
        {**ok, "source_id": "e", "type": None, "pos": 6},
    )
    broken = [(r.pos, r.rule) for r in registry.validate_sources(rows).collect()]
    assert sorted(broken) == sorted(
        [
            (1, "duplicate id"),
            (2, "empty id"), (2, "empty url"), (2, "empty name"),
            (3, "invalid type"), (3, "unsupported parser"),
            (4, "html needs a selector"),
            (5, "rss needs a mapping"),
            (6, "invalid type"), (6, "empty parser"),
        ]
    )


def test_choosing(spark):
    rows = source(
        spark,
        {"source_id": "a", "name": "x", "enabled": True, "tags": ["t", "t"], "pos": 1, "url": "second"},
        {"source_id": "a", "name": "y", "enabled": False, "tags": ["u"], "pos": 0, "url": "first"},
        {"source_id": "b", "name": "z", "priority": 5, "pos": 2},
    )
    assert [r.name for r in registry.enabled_sources(rows).collect()] == ["x"]
    assert registry.source_by_id(rows, "a").first().url == "first"
    assert registry.source_by_id(rows, "none").count() == 0
    assert registry.sources_by_tag(rows, "t").count() == 1
    assert registry.filter_sources_by_name(rows, " x, z,,q").count() == 2
    assert registry.filter_sources_by_name(rows, "").count() == 3
    assert [r.source_id for r in registry.frontier_order(rows).collect()] == ["b", "a", "a"]
    assert registry.frontier_top(rows, 1).first().source_id == "b"


def test_paginate_bounds(spark):
    page = lambda **k: {"enabled": True, "start_page": None, "max_pages": None, "param_name": "p", **k}
    rows = source(
        spark,
        {"source_id": "a", "url": "h", "pagination": page(start_page=4, max_pages=3)},
        {"source_id": "b", "url": "h", "pagination": page(max_pages=0)},
        {"source_id": "c", "url": "h", "pagination": page(enabled=False, max_pages=9)},
        {"source_id": "d", "url": "h"},
    )
    found = {(r.source_id, r.page, r.url) for r in frontier.paginate(rows).collect()}
    assert found == {
        ("a", 4, "h?p=4"), ("a", 5, "h?p=5"), ("a", 6, "h?p=6"), ("b", 1, "h?p=1"), ("c", 1, "h"), ("d", 1, "h"),
    }


def test_sitemap_limit_over_documents(spark):
    def xml(*urls):
        return "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"

    rows = spark.createDataFrame(
        [
            ("a", 2, xml("x/4", "x/5"), False, "x", 3),
            ("a", 1, xml("x/1", "y/2", "x/3"), False, "x", 3),
            ("b", 1, xml("q", "r"), True, "x", None),
            ("c", 1, "<urlset><url>", False, None, 5),
        ],
        "source_id string, doc_pos bigint, xml string, process_all boolean, pattern string, max_urls int",
    )
    for hot_rows in (1, 10**6):
        found = sorted((r.source_id, r.url) for r in frontier.sitemap_urls(rows, hot_rows).collect())
        assert found == [("a", "x/1"), ("a", "x/3"), ("a", "x/4"), ("b", "q"), ("b", "r")]
    switched = rows.withColumn("enabled", F.when(F.col("source_id") == "b", True))
    assert sorted(r.url for r in frontier.sitemap_urls(switched).collect()) == ["q", "r"]


def test_positions_run_over_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.yaml").write_text(
            "sources:\n- {id: x, name: n, url: u, type: rss}\n- {id: %s, name: n, url: u, type: rss}\n" % name
        )
    sources = registry.load_sources(spark, str(tmp_path), "yaml")
    assert sorted((r.pos, r.source_id) for r in sources.collect()) == [(0, "x"), (1, "a"), (2, "x"), (3, "b")]
    found = [tuple(r) for r in registry.validate_sources(sources).collect() if r.rule == "duplicate id"]
    assert found == [(2, "x", "duplicate id")]
    unplaced = sources.withColumn("pos", F.lit(None).cast("bigint"))
    assert [r.rule for r in registry.validate_sources(unplaced).collect()].count("duplicate id") == 2


def test_dumps(spark, tmp_path):
    from gleanery.sources.fetches import scan_dumps

    (tmp_path / "a.html").write_text("<p>é</p>")
    row = scan_dumps(spark, str(tmp_path)).select("url", "body").first()
    assert row.url.endswith("a.html") and row.body == "<p>é</p>"


def test_table_functions_equal_the_frames(spark):
    """Odd queries, templates and bodies through both forms; wrong arguments are refused."""
    from gleanery.functions.table_functions import register_table_functions
    from gleanery.operators.robots import parse_robots
    from gleanery.sources.frontier import paginate

    register_table_functions(spark)
    rule = "struct<enabled:boolean,start_page:int,max_pages:int,param_name:string>"
    urls = [
        "https://h/a?b=1&page=9&a=%7E~*+x&bad=%zz&;c=1&d&=e#f?g", "https://h/${page}/x", "https://h", "h?page", None,
        "https://h/?q=é%20&page=1&page=2", "https://h/?a=1#",
    ]
    rules = [(True, 2, 3, "page"), (True, None, None, "p g"), (False, 4, 3, "page"), None, (None, 1, 2, "x"), (True, 0, -1, "page")]
    rows = [(f"{i}-{k}", u, r) for i, u in enumerate(urls) for k, r in enumerate(rules)]
    sources = spark.createDataFrame(rows, f"source_id string, url string, pagination {rule}")
    sources.createOrReplaceTempView("t_sources")
    found = spark.sql("SELECT * FROM glean_paginate_table(TABLE(t_sources))").collect()
    assert sorted(map(str, found)) == sorted(map(str, paginate(sources).collect()))
    bodies = spark.createDataFrame(
        [
            ("a", "User-agent: A\nuser-AGENT:b # c\nDisallow: /x\n\nAllow:/y*\nUser-agent: C\nDisallow:\nnoise\nUser-agent: c\r\nDisallow: /z\n"),
            ("b", "Disallow: /early\nUser-agent:\nDisallow: /n\nUser-agent: 　Q\nSitemap: x\nUser-agent: R\nAllow: /r:1"),
            ("c", ""), ("d", None),
        ],
        "host string, body string",
    )
    bodies.createOrReplaceTempView("t_bodies")
    found = spark.sql("SELECT * FROM glean_parse_robots_table(TABLE(t_bodies) PARTITION BY host)").collect()
    assert sorted(map(str, found)) == sorted(map(str, parse_robots(bodies).collect())) and found
    for wrong in ("TABLE(t_bodies)", "'text'"):
        with pytest.raises(Exception, match="no column|TABLE argument"):
            spark.sql(f"SELECT * FROM glean_paginate_table({wrong})")
