"""Results as JSON, CSV, XML, HTML or a database table, written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.text import escape_html
from gleanery.operators.aggregates import result_summary

# Result fields left out of JSON when empty.
OPTIONAL_FIELDS = ("author", "categories", "tags", "images", "links", "metadata")

HTML_HEAD = "<html><body><h1>Aggregated Results</h1>"
HTML_TAIL = "</body></html>"


def omit_empty(results: DataFrame) -> DataFrame:
    """Empty optional fields as null, which the JSON writer leaves out."""
    changed = {}
    for name in OPTIONAL_FIELDS:
        if name in results.columns:
            kind = results.schema[name].dataType.typeName()
            filled = F.col(name) != "" if kind == "string" else F.size(name) > 0
            changed[name] = F.when(filled, F.col(name))
    return results.withColumns(changed) if changed else results


def write_json(results: DataFrame, path: str, mode: str = "error") -> None:
    omit_empty(results).write.mode(mode).json(path)


def write_csv(results: DataFrame, path: str, mode: str = "error") -> None:
    """`Content,Error Count` of results with `contents` and `errors`."""
    (
        result_summary(results)
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def xml_ready(results: DataFrame) -> DataFrame:
    """Maps as arrays of (key, value), since XML element names cannot be data."""
    maps = [f.name for f in results.schema if f.dataType.typeName() == "map"]
    return results.withColumns({m: F.map_entries(m) for m in maps}) if maps else results


def write_xml(
    results: DataFrame,
    path: str,
    mode: str = "error",
    root: str = "results",
    row: str = "result",
) -> None:
    (
        xml_ready(results)
        .write.mode(mode)
        .format("xml")
        .option("rootTag", root)
        .option("rowTag", row)
        .save(path)
    )


def html_paragraph(content: Column) -> Column:
    return F.concat(F.lit("<p>"), escape_html(content), F.lit("</p>"))


def write_html(results: DataFrame, path: str, mode: str = "error") -> None:
    """An HTML page with one escaped paragraph per result.

    The head is the first line of the first part file and the tail the last line of
    the last one: the part files in name order are one page, and no task has to hold
    or write the whole of it.
    """
    spark = results.sparkSession
    body = result_summary(results).select(
        F.lit(1).alias("_section"),
        F.xxhash64("Content", "Error Count").alias("_order"),
        html_paragraph(F.col("Content")).alias("value"),
    )
    ends = spark.createDataFrame(
        [(0, 0, HTML_HEAD), (2, 0, HTML_TAIL)], "_section int, _order bigint, value string"
    )
    lines = body.unionByName(ends).orderBy("_section", "_order").select("value")
    lines.write.mode(mode).text(path)


def write_jdbc(
    results: DataFrame, url: str, table: str, mode: str = "append", **options: str
) -> None:
    """Results into a database table. Nested columns are written as JSON text.

    Tasks commit on their own, so a retried task may append rows again; write to a
    fresh table (`mode="overwrite"`) or give the table a primary key on the id.
    """
    flat = []
    for field in results.schema:
        nested = field.dataType.typeName() in ("array", "map", "struct")
        flat.append(F.to_json(field.name).alias(field.name) if nested else F.col(field.name))
    results.select(*flat).write.mode(mode).jdbc(url, table, properties=dict(options))


WRITERS = {"json": write_json, "csv": write_csv, "xml": write_xml, "html": write_html}


def write_results(results: DataFrame, path: str, format: str, mode: str = "error") -> None:
    if format not in WRITERS:
        raise ValueError(f"unsupported format: {format}")
    WRITERS[format](results, path, mode)
