"""The source registry: loading, checking, choosing and ordering sources."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleanery.functions.elements import needs_elements
from gleanery.functions.selectors import compiled_patterns
from gleanery.schemas import PARSERS, SOURCES


def load_sources(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """The typed source table from JSON lines, Parquet or YAML files."""
    kind = format or ("yaml" if path.endswith((".yaml", ".yml")) else "parquet" if path.endswith(".parquet") else "json")
    if kind == "yaml":
        files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
        rows = files.mapInPandas(_read_yaml, "file string, pos bigint, record string")
        # Positions run on from file to file: one row per file is all that is ordered.
        counts = rows.groupBy("file").agg(F.count("*").alias("_n"))
        before = F.coalesce(
            F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        placed = rows.join(counts.select("file", before.alias("_before")), "file")
        entry = placed.select(
            F.from_json("record", SOURCES).alias("s"), (F.col("pos") + F.col("_before")).alias("pos")
        )
        return entry.select(*(F.col("pos") if c == "pos" else F.col(f"s.{c}") for c in entry.schema["s"].dataType.names))
    return spark.read.schema(SOURCES).format(kind).load(path)


def _read_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for batch in batches:
        records = []
        for text, file in zip(batch["value"], batch["file"]):
            for pos, entry in enumerate((yaml.safe_load(text) or {}).get("sources") or []):
                records.append((file, pos, json.dumps(_source_record(entry, pos), default=str)))
        yield pd.DataFrame(records, columns=["file", "pos", "record"])


def _source_record(entry: dict, pos: int) -> dict:
    def flat(values: dict | None) -> dict | None:
        return values and {
            k: ", ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in values.items()
        }

    limit = entry.get("rate_limit") or {}
    return {
        **{k: entry.get(k) for k in ("name", "url", "type", "tags", "priority", "pagination", "sitemap", "schedule")},
        "source_id": entry.get("id"),
        "parser": entry.get("parser") or entry.get("type"),
        "enabled": bool(entry.get("enabled", False)),
        "rpm": limit.get("requests_per_minute"),
        "respect_robots": limit.get("respect_robots_txt"),
        "selectors": flat(entry.get("selectors") or entry.get("selector")),
        "mappings": flat(entry.get("mappings")),
        "headers": flat(entry.get("headers")),
        "metadata": flat(entry.get("metadata")),
        "timeout_ms": entry.get("timeout_ms"),
        "pos": pos,
    }


def validate_sources(sources: DataFrame) -> DataFrame:
    """One row (pos, source_id, rule) per broken rule.

    Of the rows with one id that at the first position is not a duplicate; rows without a
    position, or several at the first one, cannot be told apart and are all reported.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # One pre-aggregated row per id, so a very frequent id costs no more than others.
    per_pos = sources.groupBy("source_id", "pos").agg(F.count("*").alias("_n"))
    first_pos = per_pos.groupBy("source_id").agg(
        F.min("pos").alias("_first"), F.min_by("_n", "pos").alias("_ties"), F.sum("_n").alias("_n")
    )
    repeated = first_pos.filter("_n > 1").select("source_id", "_first", "_ties")
    parser = F.coalesce(F.nullif("parser", F.lit("")), "type")
    size = lambda c: F.coalesce(F.size(F.map_keys(c)), F.lit(0))
    rules = F.array_compact(
        F.array(
            F.when(blank("source_id"), "empty id"),
            F.when(
                F.col("_repeated")
                & (F.col("pos").isNull() | (F.col("pos") > F.col("_first")) | (F.col("_ties") > 1)),
                "duplicate id",
            ),
            F.when(blank("url"), "empty url"),
            F.when(blank("name"), "empty name"),
            F.when(~F.coalesce(F.col("type").isin(*PARSERS), F.lit(False)), "invalid type"),
            F.when(F.coalesce(parser, F.lit("")) == "", "empty parser"),
            F.when((parser == "html") & (size("selectors") == 0), "html needs a selector"),
            F.when(
                parser.isin("json", "xml", "rss") & (size("mappings") == 0),
                F.concat(parser, F.lit(" needs a mapping")),
            ),
            F.when((parser != "") & ~parser.isin(*PARSERS), "unsupported parser"),
        )
    )
    repeated = repeated.withColumn("_repeated", F.lit(True))
    return sources.join(repeated, "source_id", "left").select(
        "pos", "source_id", F.explode(rules).alias("rule")
    )


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled")


def source_by_id(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.filter(F.col("source_id") == source_id).orderBy("pos").limit(1)


def sources_by_tag(sources: DataFrame, tag: str) -> DataFrame:
    return sources.filter(F.array_contains("tags", tag))


def filter_sources_by_name(sources: DataFrame, names: str) -> DataFrame:
    """Keep a comma-separated list of names; an empty list keeps everything."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    return sources.filter(F.col("name").isin(wanted)) if wanted else sources


def frontier_order(sources: DataFrame) -> DataFrame:
    """Higher priority first, ties by id; a source without priority counts as 0."""
    return sources.orderBy(F.coalesce("priority", F.lit(0)).desc(), "source_id")


def frontier_top(sources: DataFrame, n: int) -> DataFrame:
    return frontier_order(sources).limit(n)


def extraction_rules(sources: DataFrame) -> DataFrame:
    """(source_id, parser, patterns, selectors, mappings): what is needed to read a body.

    Selectors of leaf forms become patterns once per source row, before the sources meet
    the pages; those with a container or a combinator stay selectors, to be met on the
    elements of the page. Blank selectors are left out. HTML records are keyed by field
    already, so their mapping is field -> field.
    """
    none = F.create_map().cast("map<string,string>")
    selectors = F.map_filter(F.coalesce("selectors", none), lambda _, s: F.coalesce(F.trim(s), F.lit("")) != "")
    parser = F.coalesce(F.nullif("parser", F.lit("")), "type")
    structured = needs_elements(selectors)
    return sources.select(
        "source_id",
        parser.alias("parser"),
        F.when((parser == "html") & ~structured, compiled_patterns(selectors)).alias("patterns"),
        F.when((parser == "html") & structured, selectors).alias("selectors"),
        F.when(parser == "html", F.transform_values(selectors, lambda k, _: k))
        .otherwise(F.coalesce("mappings", none))
        .alias("mappings"),
    )
