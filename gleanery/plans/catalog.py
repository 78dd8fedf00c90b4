"""The registered queries: every operator over whole tables.

Each returns plain columns (timestamps as microseconds, lists as joined text), so
that results can be compared with `oracle.py` value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.functions import collections as coll
from gleanery.functions import dates, text, urls
from gleanery.functions.registry import Registry
from gleanery.functions.selectors import first_match
from gleanery.functions.sql_names import register_all
from gleanery.functions.table_functions import register_table_functions
from gleanery.operators import aggregates, extract, fetches, filters, joins, limits, normalize, robots
from gleanery.plans import flow, views
from gleanery.session import configure, scratch_dir
from gleanery.sinks import committed, writers
from gleanery.sources import fetches as scanned
from gleanery.sources import frontier, registry
from gleanery.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

AGENT = "Bot"
INCLUDE = ["the", "der", "que"]
EXCLUDE = ["%%%", "###"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def _joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def _entries(name: str | Column, alias: str) -> Column:
    """A map as sorted `key=value` text."""
    pairs = F.array_sort(F.map_entries(name))
    return F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"
    ).alias(alias)


# --- sources and crawl planning -------------------------------------------------


@query
def load_sources(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "sources") + "/sources.json"
    views.page_sources(spark, sf).write.json(path)
    return registry.load_sources(spark, path).select(
        "source_id", "name", "url", "parser", "enabled", "priority", "rpm", _joined("tags"), "pos",
        F.col("pagination.max_pages").alias("max_pages"),
        _entries("headers", "headers"),
    )


@query
def validate_sources(spark: SparkSession, sf: str) -> DataFrame:
    return registry.validate_sources(views.broken_sources(spark, sf))


@query
def enabled_sources(spark: SparkSession, sf: str) -> DataFrame:
    return registry.enabled_sources(views.page_sources(spark, sf)).select("source_id", "name")


@query
def source_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return registry.source_by_id(views.broken_sources(spark, sf), "p13").select("source_id", "pos", "url")


@query
def sources_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return registry.sources_by_tag(views.page_sources(spark, sf), "blog").select("source_id", "name")


@query
def filter_sources_by_name(spark: SparkSession, sf: str) -> DataFrame:
    ends = views.page_sources(spark, sf).agg(F.min("name"), F.max("name")).first()
    names = ", ".join([*(n for n in ends if n), "none"])
    return registry.filter_sources_by_name(views.page_sources(spark, sf), names).select("source_id", "name")


@query
def frontier_order(spark: SparkSession, sf: str) -> DataFrame:
    return registry.frontier_order(views.page_sources(spark, sf)).select("source_id", "priority")


@query
def frontier_top(spark: SparkSession, sf: str) -> DataFrame:
    return registry.frontier_top(views.page_sources(spark, sf), 20).select("source_id", "priority")


@query
def render_url_template(spark: SparkSession, sf: str) -> DataFrame:
    template = F.concat("url", F.lit("/${page}/${date}/${page}"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int"))
    return views.read(spark, sf, "pages").select(
        "page_id", urls.render_url_template(template, day).alias("rendered")
    )


@query
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.paginate(views.page_sources(spark, sf))


@query
def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.sitemap_urls(views.sitemaps(spark, sf))


@query
def sitemap_documents(spark: SparkSession, sf: str) -> DataFrame:
    roots, documents = views.sitemap_index(spark, sf)
    found = frontier.sitemap_documents(roots, documents)
    return found.select("source_id", "url", "error", F.length("xml").alias("chars"))


@query
def sitemap_index_urls(spark: SparkSession, sf: str) -> DataFrame:
    roots, documents = views.sitemap_index(spark, sf)
    found = frontier.sitemap_documents(roots, documents).where("error is null")
    rules = views.sources(spark, sf).select("source_id", "sitemap.*")
    return frontier.sitemap_urls(found.join(rules, "source_id"))


@query
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages")
    return pages.select("page_id", urls.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query
def scan_fetches(spark: SparkSession, sf: str) -> DataFrame:
    from gleanery.schemas import PAGES
    from gleanery.sources.fetches import scan_fetches as scan

    return scan(spark, f"{sf}/pages.parquet", PAGES).select(
        "page_id", "url", F.length("html").alias("chars")
    )


@query
def scan_dump_records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "dump") + "/dump"
    record = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.coalesce("text", F.lit("")))
    end = "\n\x1e\n"
    views.read(spark, sf, "documents").select(record.alias("value")).write.option("lineSep", end).text(path)
    records = scanned.scan_dump_records(spark, path, end)
    key = F.substring_index("body", "\t", 1)
    text_of = F.substring("body", F.length(key) + 2, F.length("body"))
    return records.select(key.cast("bigint").alias("doc_id"), F.md5(text_of).alias("text"))


# --- robots.txt -----------------------------------------------------------------


@query
def parse_robots(spark: SparkSession, sf: str) -> DataFrame:
    return robots.parse_robots(views.robots(spark, sf))


@query
def robots_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_sitemaps(views.robots(spark, sf))


@query
def robots_crawl_delay(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_crawl_delay(views.robots(spark, sf))


@query
def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages").select("page_id", "url")
    return robots.robots_allowed(pages, views.robots(spark, sf), AGENT)


@query
def robots_allowed_any_agent(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages").select("page_id", "url")
    bodies = robots.robots_status_policy(views.robots(spark, sf))
    return robots.robots_blocked(pages, bodies, "Unnamed")


@query
def robots_asof(spark: SparkSession, sf: str) -> DataFrame:
    found = robots.robots_asof(
        views.requests(spark, sf).select("id", "host", "ts"), views.snapshots(spark, sf), 180
    )
    return found.select("id", "host", _micros("ts"), _micros("robots_fetched_at"), "robots_version")


@query
def robots_status_policy(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_status_policy(views.robots(spark, sf)).select(
        "host", "status", F.length("body").alias("chars"), "warning"
    )


# --- limits, politeness, retries ------------------------------------------------


@query
def domain_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.urls(spark, sf).select("page_id", "host")
    return limits.domain_rate_limit(pages, views.sources(spark, sf)).select("page_id", "host", "rpm")


@query
def token_bucket_schedule(spark: SparkSession, sf: str) -> DataFrame:
    requests = views.requests(spark, sf)
    planned = limits.token_bucket_schedule(requests, key="host")
    return planned.select("id", "host", _micros("ts"), _micros("release_ts"), "wait_ms")


@query
def rate_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = limits.rate_audit(views.requests(spark, sf), views.request_limits(spark, sf), default=6)
    return found.select("host", _micros("minute"), "n", "rpm")


@query
def crawl_delay_audit(spark: SparkSession, sf: str) -> DataFrame:
    requests = views.requests(spark, sf).select("id", "host", "ts")
    found = limits.crawl_delay_audit(requests, views.request_delays(spark, sf))
    return found.select("id", "host", _micros("ts"), "gap_us", "delay_ms")


@query
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    planned = limits.retry_schedule(views.attempts(spark, sf), {"max_retries": 9})
    return planned.select(
        "id", "url", "error", "retryable", "attempt", "give_up", "delay_ms", _micros("next_at")
    )


# --- fetch records --------------------------------------------------------------


@query
def classify_fetch(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.fetches(spark, sf).drop("error")
    return fetches.classify_fetch(rows).select("page_id", "status", "error")


@query
def to_parse_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fetches.to_parse_jobs(fetches.classify_fetch(views.fetches(spark, sf)))
    return jobs.select("page_id", "source_id", F.length("body").alias("chars"))


@query
def effective_headers(spark: SparkSession, sf: str) -> DataFrame:
    sources = views.page_sources(spark, sf)
    return sources.select("source_id", _entries(coll.effective_headers(F.col("headers")), "headers"))


# --- extraction -----------------------------------------------------------------


@query
def extract_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages")
    fields = {
        "title": "h1", "content": "article", "author": "div.ad", "url": "a[href]", "date": "footer",
    }
    return extract.extract_html(pages, fields).withColumn("content", F.md5("content"))


@query
def extract_selectors(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages")
    fields = {
        "title": "article > h2, article > h1", "category": "nav li:nth-child(2) a",
        "url": "nav > ul > li:last-child > a", "author": "body > div.ad", "date": "article + footer",
    }
    return extract.extract_html(pages, fields)


@query
def extract_selector_lists(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages")
    lists = extract.extract_multi(pages, {"links": "nav li > a", "tags": "ul > li:nth-child(n+2)"})
    return lists.select("page_id", _joined("links"), _joined("tags"))


@query
def extract_html_items(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages").filter(F.col("html").isNotNull())
    return extract.extract_html_items(pages, "li", {"title": "a", "url": "a"})


@query
def selector_fallback(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages")
    title = first_match("title", F.col("html"), ".headline, #main, h2, h1, title")
    return pages.select("page_id", title.alias("title"))


@query
def extract_multi(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages")
    lists = extract.extract_multi(pages, {"links": "a", "tags": "li", "images": "img"})
    return lists.select("page_id", _joined("links"), _joined("tags"), F.size("images").alias("n_images"))


@query
def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    mappings = {
        "container": "data.products", "title": "name", "content": "description",
        "category": "category", "price": "price", "k": "k",
    }
    return _record_items(extract.extract_json(views.json_bodies(spark, sf), mappings))


@query
def extract_xml(spark: SparkSession, sf: str) -> DataFrame:
    mappings = {
        "title": "name", "content": "description", "category": "category", "price": "price", "k": "k",
    }
    return _record_items(extract.extract_xml(views.xml_bodies(spark, sf), mappings))


@query
def extract_json_paths(spark: SparkSession, sf: str) -> DataFrame:
    mappings = {
        "container": "data.rows", "title": "name.first", "author": "name['last name']", "content": "text",
        "category": "tags[1]", "k": "meta[0].k",
    }
    found = extract.extract_json(views.nested_json_bodies(spark, sf), mappings)
    return found.select(
        F.col("extra")["k"].cast("bigint").alias("doc_id"), "title", "author", "category", F.md5("content").alias("content")
    )


@query
def extract_xml_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "xml_files") + "/items"
    docs = views.read(spark, sf, "documents").select(
        F.col("doc_id").alias("k"), F.col("source").alias("name"), F.col("text").alias("description"),
        F.col("lang").alias("category"), F.col("n_chars").alias("price"),
    )
    writers.write_xml(docs, path, root="items", row="item")
    mappings = {
        "title": "name", "content": "description", "category": "category", "price": "price", "k": "k",
    }
    return _record_items(extract.extract_xml(scanned.scan_xml(spark, path, "item"), mappings))


def _record_items(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("extra")["k"].cast("bigint").alias("doc_id"),
        "title",
        F.md5("content").alias("content"),
        "category",
        F.col("extra")["price"].cast("bigint").alias("price"),
    )


@query
def extract_rss(spark: SparkSession, sf: str) -> DataFrame:
    mappings = {
        "title": "title", "content": "description", "date": "pubDate", "category": "category", "url": "link",
    }
    found = extract.extract_rss(views.rss_bodies(spark, sf), mappings)
    return found.select(
        "title", F.md5("content").alias("content"), "category", "url",
        F.unix_micros(dates.parse_date(F.col("date"))).alias("date"),
    )


@query
def dispatch_extract(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fetches.to_parse_jobs(views.bodies(spark, sf))
    found = extract.dispatch_extract(jobs, views.sources(spark, sf))
    return found.select("page_id", "extracted_by", "title", "url", "date", "error")


@query
def dispatch_containers(spark: SparkSession, sf: str) -> DataFrame:
    found = extract.dispatch_extract(views.container_bodies(spark, sf), views.container_sources(spark, sf))
    return found.select("page_id", "item_no", "title", "url", "error")


@query
def stream_containers(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_dir(spark, "stream_containers")
    arriving = views.container_bodies_of(_page_stream(spark, sf))
    flowing = streams.stream_items(arriving, views.container_sources(spark, sf))
    streams.run_to_end(streams.stream_sink(flowing, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").select("page_id", "item_no", "title", "url", "error")


@query
def extra_fields(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fetches.to_parse_jobs(views.bodies(spark, sf))
    found = extract.dispatch_extract(jobs, views.sources(spark, sf))
    return found.filter("error is null").select("page_id", _entries("extra", "extra"))


@query
def stamp_items(spark: SparkSession, sf: str) -> DataFrame:
    sources = views.sources(spark, sf)
    jobs = fetches.to_parse_jobs(views.bodies(spark, sf))
    found = extract.dispatch_extract(jobs, sources).filter("error is null")
    return extract.stamp_items(found, sources, views.run_ts()).select(
        "page_id", "source_name", "source_url", _micros("fetched_at"), _micros("parsed_at"), "extracted_by"
    )


# --- normalization --------------------------------------------------------------


@query
def normalize_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_by_type(views.padded_texts(spark, sf)).select(
        "doc_id", F.md5("content").alias("content"), "error"
    )


@query
def trim_field(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.padded_texts(spark, sf)
    return rows.select("doc_id", F.md5(text.trim_text(F.col("content"))).alias("trimmed"))


@query
def truncate_field(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.read(spark, sf, "documents")
    return docs.select(
        "doc_id",
        text.truncate_text(F.col("text"), normalize.TITLE_LENGTH).alias("title"),
        F.md5(text.truncate_text(F.col("text"), normalize.CONTENT_LENGTH)).alias("content"),
    )


@query
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.read(spark, sf, "pages")
    return pages.select(
        "page_id", F.md5(text.strip_html(F.col("html"))).alias("visible"),
        F.length(text.strip_html(F.col("html"))).alias("chars"),
    )


@query
def format_date(spark: SparkSession, sf: str) -> DataFrame:
    return views.read(spark, sf, "events").select("event_id", dates.format_date(F.col("ts")).alias("date"))


@query
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    return views.date_texts(spark, sf).select(
        "event_id", F.unix_micros(dates.parse_date(F.col("text"))).alias("parsed")
    )


@query
def default_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    read = dates.parse_date(F.col("text"))
    return views.date_texts(spark, sf).select(
        "event_id", F.unix_micros(dates.default_timestamp(read, views.run_ts())).alias("date")
    )


@query
def normalize_categories(spark: SparkSession, sf: str) -> DataFrame:
    return views.categories(spark, sf).select(
        "doc_id", coll.normalize_categories(F.col("categories")).alias("categories")
    ).select("doc_id", _joined("categories"))


@query
def default_type(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(
        F.array(*(F.lit(v) for v in ("", "news", "article", "gossip", None))), (F.col("doc_id") % 5).cast("int")
    )
    typed = views.read(spark, sf, "documents").select("doc_id", coll.default_type(kind).alias("type"))
    return typed.withColumn("known", coll.is_result_type(F.col("type")))


@query
def build_result_items(spark: SparkSession, sf: str) -> DataFrame:
    built = normalize.build_result_items(views.items(spark, sf), views.run_ts())
    return built.select(
        "id", "source_id", "content_id", "url", "title", "type", _micros("timestamp"),
        _joined("categories"), _micros("created_at"),
    )


# --- filters --------------------------------------------------------------------


@query
def filter_date(spark: SparkSession, sf: str) -> DataFrame:
    events = views.read(spark, sf, "events")
    return filters.filter_date(events, "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z", "ts").select(
        "event_id", _micros("ts")
    )


@query
def filter_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.read(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("content")
    )
    return filters.filter_keywords(docs, ["SRC1", "the ", "queaux"], EXCLUDE).select("doc_id", "title")


@query
def filter_keyword_tables(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.read(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("content")
    )
    include, exclude = views.keywords(spark, sf)
    return filters.filter_keyword_tables(docs, include, exclude).select("doc_id", "title")


# --- joins ----------------------------------------------------------------------


@query
def enrich_with_source(spark: SparkSession, sf: str) -> DataFrame:
    sources = views.sources(spark, sf).select("source_id", "name", "rpm")
    return joins.enrich_with_source(views.items(spark, sf), sources).select(
        "page_id", "source_id", "name", "rpm", "title"
    )


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    """Known sources and, per page, one planned source that was never fetched."""
    planned = views.read(spark, sf, "pages").filter("page_id % 3 = 0").select(
        F.concat(F.lit("new"), F.col("page_id").cast("string")).alias("source_id"), F.lit("planned").alias("name")
    )
    return views.sources(spark, sf).select("source_id", "name").unionByName(planned)


@query
def source_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return joins.source_outcomes(
        _registered(spark, sf), views.fetches(spark, sf), views.parses(spark, sf)
    )


@query
def failed_sources(spark: SparkSession, sf: str) -> DataFrame:
    return joins.failed_sources(_registered(spark, sf), views.fetches(spark, sf)).select("source_id")


@query
def live_sources(spark: SparkSession, sf: str) -> DataFrame:
    return joins.live_sources(_registered(spark, sf), views.fetches(spark, sf)).select("source_id")


# --- aggregates -----------------------------------------------------------------


@query
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = aggregates.run_stats(
        views.sources(spark, sf), views.fetches(spark, sf), views.parses(spark, sf)
    )
    return _plain_stats(stats)


def _plain_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"start_time": F.unix_micros("start_time"), "end_time": F.unix_micros("end_time")})


@query
def source_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_stats(aggregates.source_stats(views.fetches(spark, sf), views.parses(spark, sf)))


@query
def aggregate_results(spark: SparkSession, sf: str) -> DataFrame:
    items = normalize.build_result_items(views.items(spark, sf), views.run_ts())
    result = aggregates.aggregate_results(items, views.fetches(spark, sf), views.run_ts(), part_size=10)
    return result.select(
        "source_id", "part", "part_count",
        F.array_join(F.transform("items", lambda i: F.concat(i["id"], F.lit(" "), i["title"])), "|").alias("items"),
        "source_count", "successful_count", "failed_count", "total_fetch_time_ms", _micros("created_at"),
    )


def _outcome_columns(fetched: DataFrame) -> DataFrame:
    title = first_match("title", F.col("body"), "h1")
    return fetched.select("page_id", "source_id", title.alias("content"), "error")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcome_columns(views.fetches(spark, sf))


@query
def result_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = aggregates.result_rollup(_outcomes(spark, sf), part_size=10)
    return rolled.select(
        "source_id", "part", "part_count", _joined("contents"),
        F.col("statistics")["contents"].alias("n_contents"), F.col("statistics")["errors"].alias("n_errors"),
        _joined("errors"),
    )


@query
def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    rolled = aggregates.result_rollup(_outcomes(spark, sf), part_size=10)
    return aggregates.result_summary(rolled).withColumnsRenamed(
        {"Content": "content", "Error Count": "error_count"}
    )


@query
def fetch_latency(spark: SparkSession, sf: str) -> DataFrame:
    found = aggregates.fetch_latency(views.fetches(spark, sf))
    thousandths = {c: F.round(F.col(f"{c}_ms") * 1000).cast("bigint") for c in ("mean", "p50", "p95")}
    return found.select(
        "source_id", "fetches", "total_ms", *(v.alias(f"{c}_us") for c, v in thousandths.items())
    )


# --- collections ----------------------------------------------------------------


@query
def union_items(spark: SparkSession, sf: str) -> DataFrame:
    items = views.items(spark, sf)
    extra = items.filter("page_id % 4 = 0").select("page_id", "source_id", "title")
    return aggregates.union_items(items, items.filter("page_id % 2 = 0"), extra)


@query
def append_values(spark: SparkSession, sf: str) -> DataFrame:
    absent = F.when(F.col("doc_id") % 4 != 0, F.col("categories"))
    grown = coll.append_values(absent, F.lit("new"), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return views.categories(spark, sf).select("doc_id", grown.alias("categories")).select(
        "doc_id", _joined("categories")
    )


@query
def put_metadata(spark: SparkSession, sf: str) -> DataFrame:
    turns = views.read(spark, sf, "conversations")
    first = F.create_map(F.col("role"), F.lit("first"), F.lit("turn"), F.col("turn").cast("string"))
    grown = coll.put_metadata(F.when(F.col("turn") > 0, first), F.lit("user"), F.lit("last"))
    return turns.select("conv_id", "turn", _entries(grown, "metadata"))


# --- sinks: written, read back --------------------------------------------------


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.result_rollup(_outcomes(spark, sf), part_size=10)


@query
def write_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "json") + "/out"
    items = normalize.build_result_items(views.items(spark, sf), views.run_ts())
    rows = items.withColumn("tags", F.array().cast("array<string>")).withColumn("author", F.lit(""))
    writers.write_json(rows, path)
    lines = spark.read.text(path)
    record = F.from_json("value", "id string, title string, type string, timestamp timestamp, categories array<string>")
    return lines.select(
        record.alias("r"),
        (F.contains("value", F.lit('"tags"')) | F.contains("value", F.lit('"author"'))).alias("has_empty"),
    ).select("r.id", "r.title", "r.type", F.unix_micros("r.timestamp").alias("timestamp"),
             F.array_join("r.categories", "|").alias("categories"), "has_empty")


@query
def write_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "csv") + "/out"
    writers.write_results(_results(spark, sf), path, "csv")
    return _read_report(spark, path)


def _read_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = (
        spark.read.schema("Content string, `Error Count` bigint")
        .option("header", True).option("escape", '"').option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return rows.select(
        F.coalesce("Content", F.lit("")).alias("content"), F.col("Error Count").alias("error_count")
    )


@query
def write_xml(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "xml") + "/out"
    writers.write_results(_results(spark, sf), path, "xml")
    schema = (
        "source_id string, part bigint, contents array<string>, errors array<string>, "
        "statistics array<struct<key: string, value: bigint>>"
    )
    rows = spark.read.format("xml").schema(schema).option("rowTag", "result").option(
        "ignoreSurroundingSpaces", False
    ).load(path)
    return rows.select(
        "source_id", "part", F.coalesce(F.array_join("contents", "|"), F.lit("")).alias("contents"),
        F.coalesce(F.array_join("errors", "|"), F.lit("")).alias("errors"),
        F.map_from_entries("statistics")["contents"].alias("n_contents"),
    )


@query
def write_html(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "html") + "/out"
    writers.write_results(_results(spark, sf), path, "html")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def write_results(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "results") + "/out"
    writers.write_results(_results(spark, sf), path, "json")
    rows = spark.read.schema(
        "source_id string, part bigint, contents array<string>, errors array<string>"
    ).json(path)
    return rows.select("source_id", "part", _joined("contents"), _joined("errors"))


# --- streams: run to the end over the files, read back --------------------------


def _page_stream(spark: SparkSession, sf: str) -> DataFrame:
    from gleanery.schemas import PAGES

    return streams.read_stream(spark, f"{sf}/pages.parquet", PAGES)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    from gleanery.schemas import EVENTS

    return streams.read_stream(spark, f"{sf}/events.parquet", EVENTS)


@query
def stream_items(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_dir(spark, "stream_items")
    arriving = views.bodies_of(_page_stream(spark, sf))
    flowing = streams.stream_items(arriving, views.sources(spark, sf))
    streams.run_to_end(streams.stream_sink(flowing, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").select("page_id", "extracted_by", "title", "url", "error")


@query
def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_dir(spark, "stream_stats")
    counters = streams.stream_stats(views.fetches_of(_page_stream(spark, sf)))
    keys = ["source_id"]
    streams.run_to_end(streams.update_sink(counters, f"{base}/out", f"{base}/checkpoint"))
    return streams.latest_rows(spark, f"{base}/out", keys).select(
        "source_id", "processed_sources", "successful_fetches", "failed_fetches"
    )


@query
def stream_rate_audit(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_dir(spark, "stream_rate_audit")
    requests = views.requests_of(_event_stream(spark, sf))
    found = streams.stream_rate_audit(requests, views.request_limits(spark, sf), default=6)
    streams.run_to_end(streams.update_sink(found, f"{base}/out", f"{base}/checkpoint"))
    rows = streams.latest_rows(spark, f"{base}/out", ["host", "minute"])
    return rows.select("host", _micros("minute"), "n", "rpm")


def _outcome_counters(spark: SparkSession, sf: str, name: str) -> DataFrame:
    base = scratch_dir(spark, name)
    fetched = views.fetches_of(_page_stream(spark, sf))
    parsed = views.parses_of(views.fetches_of(_page_stream(spark, sf)))
    counters = streams.stream_outcomes(fetched, parsed)
    streams.run_to_end(streams.update_sink(counters, f"{base}/out", f"{base}/checkpoint"))
    return streams.latest_rows(spark, f"{base}/out", ["source_id"])


@query
def stream_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_stats(_outcome_counters(spark, sf, "stream_outcomes"))


@query
def stream_run(spark: SparkSession, sf: str) -> DataFrame:
    latest = _outcome_counters(spark, sf, "stream_run")
    return _plain_stats(streams.run_of(views.sources(spark, sf), latest))


@query
def stream_report(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_dir(spark, "stream_report")
    found = _outcome_columns(views.fetches_of(_page_stream(spark, sf)))
    results = found.select(
        F.array_compact(F.array("content")).alias("contents"), F.array_compact(F.array("error")).alias("errors")
    )
    for _ in range(2):  # the second run restarts from the checkpoint and adds nothing
        sink = streams.stream_sink(results, f"{base}/out", f"{base}/checkpoint", format="csv")
        streams.run_to_end(sink)
    return committed.read_committed(spark, f"{base}/out", lambda folders: _read_report(spark, folders))


@query
def stream_sink(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_dir(spark, "stream_sink")
    rows = views.fetches_of(_page_stream(spark, sf)).select("page_id", "url", "error")
    for _ in range(2):  # the second run restarts from the checkpoint and adds nothing
        sink = streams.stream_sink(rows, f"{base}/out", f"{base}/checkpoint", format="json")
        streams.run_to_end(sink)
    return spark.read.schema("page_id bigint, url string, error string").json(f"{base}/out")


# --- extension points and SQL names ---------------------------------------------


@query
def register_normalizer(spark: SparkSession, sf: str) -> DataFrame:
    known = Registry()
    known.register_normalizer("pdf", lambda c: F.lower(text.trim_text(c)))
    known.register_normalizer("json", lambda c: F.length(c).cast("string"))
    return normalize.normalize_by_type(views.padded_texts(spark, sf), known).select(
        "doc_id", F.md5("content").alias("content"), "error"
    )


@query
def register_extractor(spark: SparkSession, sf: str) -> DataFrame:
    known = Registry()
    known.register_extractor(
        "pdf",
        lambda jobs: jobs.select(
            "page_id", "source_id", "url", F.lit("pdf").alias("extracted_by"),
            F.regexp_extract("body", r"<title>([^<]*)</title>", 1).alias("title"),
        ),
    )
    jobs = fetches.to_parse_jobs(views.bodies(spark, sf))
    found = extract.dispatch_extract(jobs, views.sources(spark, sf), known)
    return found.select("page_id", "extracted_by", "title", "error")


@query
def register_reader(spark: SparkSession, sf: str) -> DataFrame:
    known = Registry()
    known.register_reader(
        "pdf",
        lambda body, mappings: F.array(
            F.create_map(F.lit("head"), F.regexp_extract(body, r"<title>([^<]*)</title>", 1))
        ),
    )
    mapped = F.when(F.col("parser") == "pdf", F.create_map(F.lit("title"), F.lit("head"))).otherwise(F.col("mappings"))
    sources = views.sources(spark, sf).withColumn("mappings", mapped)
    jobs = fetches.to_parse_jobs(views.bodies(spark, sf))
    found = extract.dispatch_extract(jobs, sources, known)
    return found.select("page_id", "extracted_by", "title", "error")


@query
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    register_all(spark)
    views.padded_texts(spark, sf).createOrReplaceTempView("glean_texts")
    return spark.sql(
        "SELECT doc_id, md5(glean_trim(content)) AS trimmed, "
        "md5(glean_strip_html(content)) AS stripped, "
        "md5(glean_normalize(content, content_type)) AS normalized, "
        "glean_normalize_error(content, content_type) AS error, "
        "glean_truncate(glean_trim(content), 30) AS short, "
        "glean_default_type(CASE WHEN doc_id % 2 = 0 THEN content_type END) AS type, "
        "glean_format_date(timestamp_seconds(1704067200 + doc_id)) AS date, "
        "array_join(glean_categories(array('Tech', content_type)), '|') AS categories "
        "FROM glean_texts"
    )


@query
def sql_paginate(spark: SparkSession, sf: str) -> DataFrame:
    register_all(spark)
    views.page_sources(spark, sf).createOrReplaceTempView("glean_sources")
    return spark.sql(
        "SELECT s.source_id, p.page, p.url FROM glean_sources s, "
        "LATERAL glean_paginate(s.url, s.pagination.enabled, s.pagination.start_page, "
        "s.pagination.max_pages, s.pagination.param_name) p"
    )


@query
def sql_parse_robots(spark: SparkSession, sf: str) -> DataFrame:
    register_all(spark)
    views.robots(spark, sf).createOrReplaceTempView("glean_robots")
    return spark.sql(
        "SELECT r.host, p.agent, p.path, p.allow, p.pos "
        "FROM glean_robots r, LATERAL glean_parse_robots(r.body) p"
    )


@query
def sql_paginate_table(spark: SparkSession, sf: str) -> DataFrame:
    register_table_functions(spark)
    views.page_sources(spark, sf).createOrReplaceTempView("glean_sources")
    return spark.sql("SELECT * FROM glean_paginate_table(TABLE(glean_sources))")


@query
def sql_parse_robots_table(spark: SparkSession, sf: str) -> DataFrame:
    register_table_functions(spark)
    views.robots(spark, sf).createOrReplaceTempView("glean_robots")
    return spark.sql("SELECT * FROM glean_parse_robots_table(TABLE(glean_robots) PARTITION BY host)")


# --- whole dataflows ------------------------------------------------------------


@query
def crawl_schedule(spark: SparkSession, sf: str) -> DataFrame:
    planned = flow.crawl_schedule(
        views.page_sources(spark, sf), views.robots(spark, sf), AGENT, views.run_ts()
    )
    return planned.select("source_id", "page", "url", "host", "rpm", _micros("release_ts"), "wait_ms")


@query
def host_report(spark: SparkSession, sf: str) -> DataFrame:
    return flow.host_report(views.read(spark, sf, "pages"), INCLUDE, EXCLUDE)


@query
def result_items(spark: SparkSession, sf: str) -> DataFrame:
    built = flow.result_items(views.bodies(spark, sf), views.sources(spark, sf), views.run_ts())
    return built.select("id", "source_id", "content_id", "title", _micros("timestamp"))
