"""URLs to request: numbered pages and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.functions.urls import url_with_page
from gleanery.session import written
from gleanery.operators.slices import (
    HOT_ROWS,
    carry_over,
    earlier_slices,
    slice_hot_keys,
    slice_window,
)


def paginate(sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (source_id, page, url) per page; at least one page per source. Columns
    named in `keep` are carried along."""
    enabled = F.coalesce(F.col("pagination.enabled"), F.lit(False))
    start = F.coalesce(F.col("pagination.start_page"), F.lit(1))
    count = F.when(enabled, F.greatest(F.col("pagination.max_pages"), F.lit(1))).otherwise(1)
    pages = sources.withColumn("page", F.explode(F.sequence(start, start + count - 1)))
    return pages.select(
        "source_id",
        "page",
        url_with_page(F.col("url"), F.col("page"), enabled, F.col("pagination.param_name")).alias("url"),
        *keep,
    )


def _locations(xml: Column, element: str) -> Column:
    """Trimmed `loc` of each element; null if the document holds none."""
    return F.transform(
        F.from_xml(xml, f"{element} array<struct<loc: string>>")[element], lambda u: F.trim(u["loc"])
    )


def sitemap_documents(roots: DataFrame, documents: DataFrame) -> DataFrame:
    """The sitemaps that each source reaches, through indexes of any depth.

    `roots` has source_id and url, `documents` has url and xml (one row per url). An index
    leads to the sitemaps it lists. Every source visits a document once, so indexes that
    list each other end; the place of a document is that of its first visit: the round, then
    the places in the indexes on the way. Gives (source_id, url, doc_pos, xml, error): the
    sitemaps in order of `doc_pos`, and a row with an error for a listed document that is
    missing or is neither a sitemap nor an index.

    A round reads what the round before has written: only addresses, never bodies, are
    carried from round to round, and each body is met once per source that reaches it.
    """
    kinds = documents.select(
        "url",
        F.coalesce(_locations(F.col("xml"), "sitemap"), F.array()).alias("listed"),
        F.from_xml("xml", "url array<struct<loc: string>>")["url"].isNotNull().alias("holds_urls"),
        F.rlike("xml", F.lit(r"(?i)<(?:\w+:)?urlset[\s/>]")).alias("is_sitemap"),
    )
    kinds = written(
        kinds.select("url", "listed", (F.col("holds_urls") | F.coalesce("is_sitemap", F.lit(False))).alias("leaf")), "sitemap-kinds"
    )
    frontier = roots.groupBy("source_id", F.trim("url").alias("url")).agg(F.lit("").alias("doc_pos"))
    visited, number = None, 0
    while True:
        met = frontier.join(kinds, "url", "left")
        met = written(met.withColumn("round", F.lit(number)), "sitemap-round")
        visited = met if visited is None else visited.unionByName(met)
        place = F.concat("doc_pos", F.lpad(F.col("_pos").cast("string"), 9, "0"), F.lit("/"))
        found = met.select("source_id", "doc_pos", F.posexplode("listed").alias("_pos", "next")).where("next <> ''")
        found = found.groupBy("source_id", F.col("next").alias("url")).agg(F.min(place).alias("doc_pos"))
        frontier = written(found.join(visited.select("source_id", "url"), ["source_id", "url"], "left_anti"), "sitemap-frontier")
        number += 1
        if frontier.isEmpty():
            break
    known, empty = F.col("listed").isNotNull(), F.size("listed") == 0
    error = F.when(~known, F.lit("missing sitemap document")).when(~F.col("leaf") & empty, F.lit("not a sitemap"))
    place = F.concat(F.lpad(F.col("round").cast("string"), 4, "0"), F.lit(":"), "doc_pos")
    reached = visited.select("source_id", "url", place.alias("doc_pos"), "leaf", error.alias("error"))
    reached = reached.where("leaf or error is not null").drop("leaf")
    return reached.join(documents.select("url", "xml"), "url", "left").select("source_id", "url", "doc_pos", "xml", "error")


def sitemap_urls(sitemaps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Page URLs (source_id, url) listed by sitemap documents.

    Input columns: source_id, doc_pos (a number, or the place of `sitemap_documents`), xml,
    process_all, pattern, max_urls, and `enabled` where sitemaps can be switched off (null is off). The limit of a source is
    shared out by counts: a document gives what the documents before it left over, so no
    URL is ranked, and a source with many documents is cut into slices.
    """
    if "enabled" in sitemaps.columns:
        sitemaps = sitemaps.filter(F.coalesce("enabled", F.lit(False)))
    listed = _locations(F.col("xml"), "url")
    everything = F.coalesce("process_all", F.lit(False)) | F.col("pattern").isNull()
    wanted = F.filter(listed, lambda u: (u != "") & (everything | F.rlike(u, F.col("pattern"))))
    limit = F.coalesce("max_urls", F.lit(2**31 - 1))
    documents = sitemaps.select(
        "source_id",
        "doc_pos",
        limit.cast("bigint").alias("_limit"),
        F.slice(F.coalesce(wanted, F.array()), F.lit(1), F.greatest(limit, F.lit(0))).alias("_urls"),
    )
    documents = documents.withColumn("_n", F.size("_urls").cast("bigint"))
    sliced = slice_hot_keys(documents, "source_id", "doc_pos", ("_urls",), hot_rows)
    order = slice_window("source_id", "doc_pos", "_urls")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    carried = carry_over(
        sliced.withColumn("_before", F.coalesce(before, F.lit(0))),
        "source_id",
        summary={"_total": F.sum("_n")},
        carried={"_carry": F.sum("_total").over(earlier_slices("source_id"))},
    )
    left = F.col("_limit") - F.col("_before") - F.coalesce("_carry", F.lit(0))
    taken = F.slice("_urls", F.lit(1), F.greatest(F.least(left, F.col("_n")), F.lit(0)).cast("int"))
    return carried.select("source_id", F.explode(taken).alias("url"))
