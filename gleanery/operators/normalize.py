"""Raw content and items to normalized result items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.collections import default_type, normalize_categories
from gleanery.functions.dates import default_timestamp, parse_date
from gleanery.functions.registry import Registry
from gleanery.functions.text import strip_html, trim_text, truncate_text

TITLE_LENGTH = 100
CONTENT_LENGTH = 1000


def normalize_by_type(contents: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Normalize `content` by `content_type`; rows without content get an `error`."""
    known = registry or Registry()
    content, kind = F.col("content"), F.col("content_type")
    error = known.normalize_error(content, kind)
    return contents.select(
        *(c for c in contents.columns if c not in ("content", "error")),
        F.when(error.isNull(), known.normalized(content, kind)).alias("content"),
        error.alias("error"),
    )


def normalize_items(items: DataFrame) -> DataFrame:
    """Title trimmed and cut; content stripped, trimmed and cut; date read; category mapped."""
    return items.withColumns(
        {
            "title": truncate_text(trim_text(F.col("title")), TITLE_LENGTH),
            "content": truncate_text(strip_html(F.col("content")), CONTENT_LENGTH),
            "date": parse_date(F.col("date")),
            "category": normalize_categories(F.array("category"))[0],
        }
    )


def result_id(source_id: Column, content_id: Column, url: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (source_id, content_id, url)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def build_result_items(
    items: DataFrame, run_ts: datetime | Column, content_id: str = "page_id"
) -> DataFrame:
    """Items in the result schema, in one projection. Optional columns may be absent."""
    now = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in items.columns else F.lit(None).cast(kind)

    category = optional("category")
    categories = (
        F.col("categories")
        if "categories" in items.columns
        else F.when(category.isNotNull(), F.array(category))
    )
    metadata = optional("metadata", "map<string,string>")
    if "metadata" not in items.columns and "extra" in items.columns:
        metadata = F.col("extra")
    return items.select(
        result_id(F.col("source_id"), F.col(content_id), F.col("url")).alias("id"),
        "source_id",
        F.col(content_id).cast("string").alias("content_id"),
        "url",
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(optional("description"), F.lit("")).alias("description"),
        F.coalesce(optional("content"), F.lit("")).alias("content"),
        default_type(optional("type")).alias("type"),
        default_timestamp(optional("date", "timestamp"), now).alias("timestamp"),
        optional("author").alias("author"),
        categories.alias("categories"),
        optional("tags", "array<string>").alias("tags"),
        optional("images", "array<string>").alias("images"),
        optional("links", "array<string>").alias("links"),
        metadata.alias("metadata"),
        now.alias("created_at"),
    )
