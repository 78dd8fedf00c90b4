"""Input tables derived from the given tables by fixed formulas.

Every view grows with its table. The matching SQL is in `oracle.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery import schemas
from gleanery.functions.selectors import first_match
from gleanery.functions.urls import url_host, url_path, url_query

BASE = 1704067200  # 2024-01-01T00:00:00Z
PER_BODY = 20


def run_ts() -> Column:
    return F.timestamp_seconds(F.lit(BASE + 31 * 86400))


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.schema(getattr(schemas, table.upper())).parquet(f"{sf}/{table}.parquet")


def urls(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf, "pages").select(
        "page_id",
        "url",
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        url_query(url).alias("query"),
    )


def _parser(host: Column) -> Column:
    n = F.length(host)
    names = F.array(*(F.lit(p) for p in schemas.PARSERS))
    return F.when(n % 9 == 0, "pdf").otherwise(F.get(names, n % 4))


def _selectors(parser: Column) -> Column:
    values = {"title": ".headline, h1", "content": "article", "category": "nav a", "url": "a"}
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.when(parser == "html", pairs)


def _mappings(parser: Column) -> Column:
    json_map = {"container": "products", "title": "name", "url": "productUrl", "price": "price"}
    xml_map = {"title": "name", "url": "productUrl", "price": "price"}
    rss_map = {"title": "title", "url": "link", "date": "pubDate", "category": "category"}
    lit_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    return (
        F.when(parser == "json", lit_map(json_map))
        .when(parser == "xml", lit_map(xml_map))
        .when(parser == "rss", lit_map(rss_map))
    )


def _source_columns(key: Column, host: Column, url: Column, pos: Column, parser: Column) -> list[Column]:
    n = F.length(host)
    return [
        key.alias("source_id"),
        F.replace(host, F.lit("."), F.lit("_")).alias("name"),
        url.alias("url"),
        parser.alias("type"),
        parser.alias("parser"),
        (n % 7 != 0).alias("enabled"),
        (n % 5).cast("int").alias("priority"),
        F.split(host, r"\.").alias("tags"),
        F.when(n % 9 == 0, 0).otherwise(10 + n % 50).cast("int").alias("rpm"),
        (n % 2 == 0).alias("respect_robots"),
        _selectors(parser).alias("selectors"),
        _mappings(parser).alias("mappings"),
        F.create_map(
            F.when(n % 3 == 0, "User-Agent").otherwise("Accept"), F.concat(F.lit("a/"), n.cast("string"))
        ).alias("headers"),
        F.struct(
            (n % 2 == 0).alias("enabled"),
            (1 + n % 3).cast("int").alias("start_page"),
            (1 + n % 5).cast("int").alias("max_pages"),
            F.lit("page").alias("param_name"),
        ).alias("pagination"),
        F.struct(
            (n % 5 != 1).alias("enabled"),
            (n % 2 == 0).alias("process_all"),
            F.when(n % 7 != 0, 3 + n % 5).cast("int").alias("max_urls"),
            F.lit(".*/en/.*").alias("pattern"),
        ).alias("sitemap"),
        pos.alias("pos"),
    ]


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """One source per host, named after it."""
    hosts = urls(spark, sf).groupBy("host").agg(F.min("page_id").alias("pos"))
    host = F.col("host")
    return hosts.select(
        *_source_columns(
            host, host, F.concat(F.lit("https://"), host, F.lit("/")), F.col("pos"), _parser(host)
        )
    )


def page_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One source per page, at the page's own address or a page template."""
    host = F.col("host")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://"), host, F.lit("/list?p=${page}"))).otherwise(F.col("url"))
    key = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    return urls(spark, sf).select(*_source_columns(key, host, url, F.col("page_id"), _parser(host)))


def broken_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Page sources with one field spoilt by position."""
    pos = F.col("pos")
    case = lambda n: pos % 13 == n
    return page_sources(spark, sf).withColumns(
        {
            "source_id": F.when(case(1), F.concat(F.lit("p"), (pos - 1).cast("string")))
            .when(case(2), "")
            .otherwise(F.col("source_id")),
            "url": F.when(case(3), "").otherwise(F.col("url")),
            "name": F.when(case(4), F.lit(None)).otherwise(F.col("name")),
            "type": F.when(case(5), "pdf").when(case(6), "html").otherwise(F.col("type")),
            "parser": F.when(case(5), "pdf").when(case(6), "html").when(case(8), "").otherwise(F.col("parser")),
            "selectors": F.when(case(6), F.lit(None)).otherwise(F.col("selectors")),
            "mappings": F.when(case(7), F.lit(None)).otherwise(F.col("mappings")),
        }
    )


def status_of(page_id: Column) -> Column:
    return F.when(page_id % 10 == 0, 404).when(page_id % 25 == 3, 500).otherwise(200)


def fetches_of(pages: DataFrame) -> DataFrame:
    """Pages as recorded responses; works on batch and streaming frames."""
    page_id, host = F.col("page_id"), url_host(F.col("url"))
    status = status_of(page_id)
    submitted = F.lit(BASE * 1000) + page_id * 1000
    return pages.select(
        "page_id",
        host.alias("source_id"),
        "url",
        status.alias("status"),
        F.lit("html").alias("content_type"),
        F.when(status == 200, F.col("html")).alias("body"),
        F.timestamp_millis(submitted).alias("submitted_at"),
        F.timestamp_millis(submitted + F.length("html") % 1000).alias("fetched_at"),
        F.when(status != 200, F.concat(F.lit("HTTP error: "), status.cast("string"))).alias("error"),
    )


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    return fetches_of(read(spark, sf, "pages"))


def bodies_of(pages: DataFrame) -> DataFrame:
    """Fetches whose body is in the format of the source's parser, holding one item."""
    title = first_match("title", F.col("html"), "h1")
    escaped = _xml_text(title)
    link = _xml_text(F.col("url"))
    parser = _parser(url_host(F.col("url")))
    price = (F.col("page_id") % 100).cast("string")
    json_body = F.to_json(
        F.struct(
            F.array(
                F.struct(title.alias("name"), F.col("url").alias("productUrl"), price.alias("price"))
            ).alias("products")
        )
    )
    xml_body = F.concat(
        F.lit("<items><item><name>"), escaped, F.lit("</name><productUrl>"), link,
        F.lit("</productUrl><price>"), price, F.lit("</price></item></items>"),
    )
    rss_body = F.concat(
        F.lit("<rss><channel><title>feed</title><item><title>"), escaped, F.lit("</title><link>"),
        link, F.lit("</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>"),
    )
    body = (
        F.when(parser == "json", json_body)
        .when(parser == "xml", xml_body)
        .when(parser == "rss", rss_body)
        .otherwise(F.col("html"))
    )
    return fetches_of(pages.withColumn("html", body))


def container_sources(spark: SparkSession, sf: str) -> DataFrame:
    """HTML sources with containers, combinators and, for some, a selector no one can read."""
    n = F.length("source_id")
    nested = {"container": "div.list div.item", "title": "h2:first-child, h3:nth-of-type(1)", "url": "div > a"}
    beside = {"container": ".item + .item", "title": "p ~ h3", "url": "a"}
    whole = {"title": "div.list > div:last-child > h3", "url": "ul > li:nth-child(2) > a"}
    unreadable = {"container": "div.item", "title": "h2::text"}
    lit_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    selectors = F.when(n % 7 == 3, lit_map(unreadable)).when(n % 3 == 0, lit_map(nested))
    selectors = selectors.when(n % 3 == 1, lit_map(beside)).otherwise(lit_map(whole))
    return sources(spark, sf).withColumns(
        {"parser": F.lit("html"), "type": F.lit("html"), "selectors": selectors, "mappings": F.lit(None).cast("map<string,string>")}
    )


def container_bodies_of(pages: DataFrame) -> DataFrame:
    """Each page behind a list of items, one inside another, some of them half empty."""
    key, title = F.col("page_id").cast("string"), F.coalesce(first_match("title", F.col("html"), "h1"), F.lit(""))
    link = _xml_text(F.col("url"))
    listed = F.concat(
        F.lit('<div class="list"><div class="item"><h2>'), _xml_text(title),
        F.lit('</h2><p>one</p><div class="item"><h2>inner '), key, F.lit('</h2><p>open<div><a href="'), link,
        F.lit('#i">in</a></div></div><span></span><a href="'), link,
        F.lit('">out</a></div><div class="item extra"><h2>&nbsp;</h2><p>x<p>y</p><h3>late '), key, F.lit("</h3></div></div>"),
    )
    return pages.select(
        "page_id", url_host(F.col("url")).alias("source_id"), "url", F.concat(listed, F.coalesce("html", F.lit(""))).alias("body"),
        F.lit(200).alias("status"),
    )


def container_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return container_bodies_of(read(spark, sf, "pages"))


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return bodies_of(read(spark, sf, "pages"))


def parses(spark: SparkSession, sf: str) -> DataFrame:
    return parses_of(fetches(spark, sf))


def parses_of(fetched: DataFrame) -> DataFrame:
    page_id = F.col("page_id")
    failed = page_id % 17 == 0
    return (
        fetched
        .filter(F.col("body").isNotNull())
        .select(
            "page_id",
            "source_id",
            F.when(failed, 0).otherwise(1 + page_id % 4).alias("n_items"),
            F.when(failed, "unreadable body").alias("error"),
            (F.col("fetched_at") + F.expr("interval 5 seconds")).alias("parsed_at"),
        )
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """One item per successful fetch, from the page's headings and links."""
    pages = read(spark, sf, "pages").filter(status_of(F.col("page_id")) == 200)
    return pages.select(
        "page_id",
        url_host(F.col("url")).alias("source_id"),
        "url",
        first_match("title", F.col("html"), "h1").alias("title"),
        F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("category"),
    )


def _xml_text(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def robots(spark: SparkSession, sf: str) -> DataFrame:
    """One robots response per host, its text built from the host."""
    host = F.col("host")
    n = F.length(host)
    body = F.concat(
        F.lit("# robots of "), host, F.lit("\nUser-agent: *\nDisallow: /es\nAllow: /es/5*\nDisallow: /fr/ # no\n"),
        F.when(n % 2 == 0, F.concat(F.lit("Crawl-delay: "), (n % 7).cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("bad line\n\nUser-Agent: Bot\nUSER-AGENT: Other Bot\r\nDisallow: /en/\nDisallow:\nAllow: /en/4\nallow: /en/7\n"),
        F.when(n % 3 == 0, "Disallow: /*\n").otherwise("Disallow: /de/1?page=2\n"),
        F.lit("Sitemap: https://"), host, F.lit("/sitemap.xml\nUser-agent: Quiet\nDisallow:\n"),
        F.when(n % 5 == 0, F.concat(F.lit("sitemap:https://"), host, F.lit("/more.xml#x\ncrawl-delay: 11s\ncrawl-delay: -3\n"))).otherwise(""),
    )
    return urls(spark, sf).select("host").distinct().select(
        "host",
        F.when(n % 6 == 0, 404).when(n % 11 == 0, 503).otherwise(200).alias("status"),
        body.alias("body"),
    )


def requests_of(events: DataFrame) -> DataFrame:
    """Events as requests: user -> host, time squeezed so that limits matter."""
    micros = F.lit(BASE * 1000000) + F.expr(f"(unix_micros(ts) - {BASE * 1000000}L) div 4000")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"),
        F.timestamp_micros(micros).alias("ts"),
        (2 + F.col("user_id") % 3).cast("int").alias("rpm"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return requests_of(read(spark, sf, "events"))


def request_limits(spark: SparkSession, sf: str) -> DataFrame:
    users = read(spark, sf, "events").select("user_id").distinct()
    return users.filter("user_id % 4 <> 0").select(
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"),
        (2 + F.col("user_id") % 3).cast("int").alias("rpm"),
    )


def request_delays(spark: SparkSession, sf: str) -> DataFrame:
    users = read(spark, sf, "events").select("user_id").distinct()
    return users.filter("user_id % 3 <> 0").select(
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"),
        (1 + F.col("user_id") % 5).cast("int").alias("delay_s"),
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Three robots snapshots per host, a few minutes apart."""
    users = read(spark, sf, "events").select("user_id").distinct()
    seconds = F.lit(BASE) + F.col("user_id") % 100 + F.col("version") * 240
    return users.withColumn("version", F.explode(F.array(*(F.lit(v).cast("bigint") for v in (0, 1, 2))))).select(
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"),
        F.timestamp_seconds(seconds).alias("fetched_at"),
        "version",
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as request attempts; error events carry one of five texts."""
    texts = F.array(
        *(F.lit(t) for t in ("Read TIMEOUT", "connection refused by peer", "404 not found", "Temporary failure in name resolution", "bad certificate"))
    )
    return read(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        "ts",
        F.when(F.col("event_type").isin("error", "view"), F.get(texts, (F.col("event_id") % 5).cast("int"))).alias("error"),
    )


def json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON API answers of 20 records each."""
    record = F.struct(
        F.col("doc_id").cast("string").alias("k"),
        F.col("source").alias("name"),
        F.col("text").alias("description"),
        F.col("lang").alias("category"),
        F.col("n_chars").alias("price"),
    )
    batches = read(spark, sf, "documents").groupBy(F.expr(f"doc_id div {PER_BODY}").alias("batch"))
    return batches.agg(F.sort_array(F.collect_list(record)).alias("products")).select(
        "batch", F.to_json(F.struct(F.struct("products").alias("data"))).alias("body")
    )


def nested_json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of three shapes: an array of records, one with other values between, one record."""
    record = F.struct(
        F.struct(F.col("source").alias("first"), F.col("lang").alias("last name")).alias("name"),
        F.array("lang", "source").alias("tags"),
        "text",
        F.array(F.struct(F.col("doc_id").alias("k"))).alias("meta"),
    )
    batches = read(spark, sf, "documents").groupBy(F.expr(f"doc_id div {PER_BODY}").alias("batch"))
    rows = batches.agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))).alias("rows"))
    listed = F.transform("rows", lambda row: F.to_json(row["r"]))
    case = F.col("batch") % 3
    held = (
        F.when(case == 0, F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
        .when(case == 1, F.concat(F.lit('[7,"x",null,'), F.array_join(listed, ',["y"],'), F.lit("]")))
        .otherwise(F.get(listed, F.lit(0)))
    )
    return rows.select("batch", F.concat(F.lit('{"data":{"rows":'), held, F.lit("}}")).alias("body"))


def keywords(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Long words of the benchmark to include and of the conversations to exclude."""
    split = lambda table: read_words(spark, sf, table).distinct()
    include = split("benchmark").where(F.length("word") >= 8)
    exclude = split("conversations").where(F.length("word") >= 14)
    return include, exclude


def read_words(spark: SparkSession, sf: str, table: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf}/{table}.parquet").select("text")
    return texts.select(F.explode(F.split("text", " ")).alias("word"))


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _xml_text(value), F.lit(f"</{name}>"))


def xml_bodies(spark: SparkSession, sf: str) -> DataFrame:
    row = F.concat(
        F.lit("<item>"), _tag("k", F.col("doc_id").cast("string")), _tag("name", F.col("source")),
        _tag("description", F.col("text")), _tag("category", F.col("lang")),
        _tag("price", F.col("n_chars").cast("string")), F.lit("</item>"),
    )
    batches = read(spark, sf, "documents").groupBy(F.expr(f"doc_id div {PER_BODY}").alias("batch"))
    return batches.agg(F.collect_list(row).alias("rows")).select(
        "batch", F.concat(F.lit("<?xml version='1.0'?><items>"), F.array_join("rows", ""), F.lit("</items>")).alias("body")
    )


def rss_bodies(spark: SparkSession, sf: str) -> DataFrame:
    day = F.timestamp_seconds(F.lit(BASE) + F.col("doc_id") * 3600)
    row = F.concat(
        F.lit("<item>"), _tag("title", F.col("source")), _tag("description", F.col("text")),
        _tag("pubDate", F.date_format(day, "dd MMM yyyy HH:mm:ss 'GMT'")), _tag("category", F.col("lang")),
        _tag("link", F.concat(F.lit("https://docs.example/?a=1&id="), F.col("doc_id").cast("string"))), F.lit("</item>"),
    )
    batches = read(spark, sf, "documents").groupBy(F.expr(f"doc_id div {PER_BODY}").alias("batch"))
    return batches.agg(F.collect_list(row).alias("rows")).select(
        "batch",
        F.concat(F.lit("<rss version='2.0'><channel><title>feed</title>"), F.array_join("rows", ""), F.lit("</channel></rss>")).alias("body"),
    )


def sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap documents of up to 100 consecutive pages of a host."""
    rules = sources(spark, sf).select(
        "source_id", "sitemap.enabled", "sitemap.process_all", "sitemap.pattern", "sitemap.max_urls"
    )
    entry = F.concat(F.lit("<url><loc>"), _xml_text(F.col("url")), F.lit("</loc></url>"))
    documents = (
        urls(spark, sf)
        .groupBy(F.col("host").alias("source_id"), F.expr("page_id div 100").alias("doc_pos"))
        .agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("entry")))).alias("entries"))
    )
    xml = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.array_join(F.transform("entries", lambda e: e["entry"]), ""),
        F.lit("</urlset>"),
    )
    return documents.select("source_id", "doc_pos", xml.alias("xml")).join(rules, "source_id")


def sitemap_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The sitemaps of every host behind an index that lists itself, a second index, a page
    that is no sitemap and one that is missing. The second index leads back to the first."""
    base = F.concat(F.lit("https://"), F.col("source_id"), F.lit("/"))
    parts = sitemaps(spark, sf).select("source_id", "doc_pos", "xml")
    named = parts.withColumn("url", F.concat(base, F.lit("part-"), F.col("doc_pos").cast("string"), F.lit(".xml")))
    loc = lambda u: F.concat(F.lit("<sitemap><loc> "), u, F.lit(" </loc></sitemap>"))
    index = lambda entries: F.concat(
        F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entries, F.lit("</sitemapindex>")
    )
    hosts = named.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("doc_pos", "url"))).alias("parts"))
    first, rest = F.get("parts", F.lit(0))["url"], F.slice("parts", 2, 2**30)
    root, more = F.concat(base, F.lit("sitemap.xml")), F.concat(base, F.lit("more.xml"))
    main = index(F.concat(loc(root), loc(first), loc(more), loc(F.concat(base, F.lit("gone.xml"))), loc(F.concat(base, F.lit("page.html")))))
    second = index(F.concat(F.array_join(F.transform(rest, lambda p: loc(p["url"])), ""), loc(root), loc(first)))
    listed = hosts.select(
        F.explode(
            F.array(
                F.struct(root.alias("url"), main.alias("xml")),
                F.struct(more.alias("url"), second.alias("xml")),
                F.struct(F.concat(base, F.lit("page.html")).alias("url"), F.lit("<html><body>no</body></html>").alias("xml")),
            )
        ).alias("d")
    ).select("d.*")
    return hosts.select("source_id", root.alias("url")), named.select("url", "xml").unionByName(listed)


def categories(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.get(F.array(F.lit("Tech"), F.lit("prog"), F.lit("Technologies")), (F.col("doc_id") % 3).cast("int"))
    return read(spark, sf, "documents").select(
        "doc_id", F.array(F.upper("lang"), F.col("source"), extra).alias("categories")
    )


def date_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Event times written in several formats, with junk between them."""
    second = F.date_trunc("second", "ts")
    texts = (
        (0, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        (1, F.date_format(second, "yyyy-MM-dd")),
        (2, F.concat(F.lit("Mon, "), F.date_format(second, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))),
        (3, F.concat(F.date_format(second, "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))),
        (4, F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))),
        (5, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("\n"))),
        (6, F.lit("yesterday")),
        (7, F.concat(F.date_format(second, "dd MMM yy HH:mm:ss"), F.lit(" GMT"))),
        (8, F.concat(F.lit("Tue, "), F.date_format(second, "dd MMM yyyy HH:mm"), F.lit(" GMT"))),
        (9, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss")),
        (10, F.date_format(second, "yyyy-MM-dd HH:mm:ss")),
        (11, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SS'Z'")),
        (12, F.concat(F.date_format(second, "d MMM yyyy HH:mm:ss"), F.lit(" est"))),
        (13, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'z'")),
    )
    chosen = None
    for n, text in texts:
        hit = F.col("event_id") % 14 == n
        chosen = F.when(hit, text) if chosen is None else chosen.when(hit, text)
    return read(spark, sf, "events").select("event_id", "ts", chosen.alias("text"))


def padded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts with white space around them; some are only white space."""
    pads = F.array(*(F.lit(p) for p in (" ", "\t\n", "\xa0 ", "\u2003", "", "\u3000\r\n", "\x0b")))
    pad = F.get(pads, (F.col("doc_id") % 7).cast("int"))
    text = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 11 == 1, pad).otherwise(
        F.concat(pad, F.col("text"), pad)
    )
    kinds = F.array(*(F.lit(k) for k in ("text", "html", "json", "rss", "pdf")))
    return read(spark, sf, "documents").select(
        "doc_id", text.alias("content"), F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("content_type")
    )
