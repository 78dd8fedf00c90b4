"""Recorded responses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.schemas import FETCHES


def scan_fetches(spark: SparkSession, path: str, schema: str = FETCHES) -> DataFrame:
    """The table of fetched responses; columns and filters reach the Parquet scan."""
    return spark.read.schema(schema).parquet(path)


def scan_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as bodies, one row (url, body, fetched_at) per file."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("url"),
        F.col("content").cast("string").alias("body"),
        F.col("modificationTime").alias("fetched_at"),
    )


def scan_dump_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Records of dumps of any size: (file, block, nth, body), where `separator` ends a record.

    Spark plans byte ranges of at most ``spark.sql.files.maxPartitionBytes``; the reader of
    a range goes on to the first separator behind its start and reads up to the first one
    behind its end, so every record is read once, by one task, wherever the ranges are cut.
    `block` is the start of the range and `nth` counts its records: in their order the
    records of a file are in order. Compressed files are one range. Text after the last
    separator is a record too; an empty one is not.
    """
    records = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("value").alias("body"),
    )
    return records.where(F.length("body") > 0)


def scan_xml(spark: SparkSession, path: str, element: str = "item") -> DataFrame:
    """Large XML files as small bodies (file, block, nth, body), each with the records between
    two end tags of `element`, for `extract_xml` with that row element.

    A file is read by as many tasks as it has ranges. A record must not hold an element of
    its own name, nor its end tag in a comment or CDATA section. Names of the root and of
    what stands between records are left out.
    """
    name = re.escape(element)
    pieces = scan_dump_records(spark, path, f"</{element}>")
    empty = F.regexp_extract_all("body", F.lit(rf"(?s)<{name}(?:\s[^<>]*)?/>"), F.lit(0))
    # The last start tag that is not an empty element begins the record that the piece ends.
    record = F.regexp_extract("body", rf"(?s)^.*(<{name}(?:\s[^<>]*(?<!/))?>.*)$", 1)
    whole = F.when(record != "", F.concat(record, F.lit(f"</{element}>"))).otherwise("")
    joined = F.concat(F.lit("<records>"), F.array_join(empty, ""), whole, F.lit("</records>"))
    some = (record != "") | (F.size(empty) > 0)
    return pieces.where(some).withColumn("body", joined)
