"""SQL table functions over whole tables: `SELECT * FROM f(TABLE(t))`.

The schema of the argument is checked when the query is analyzed, and the columns of the
result follow it. Rows stream through; `PARTITION BY` and `ORDER BY` of the argument are
the caller's. The DataFrame forms (`paginate`, `parse_robots`) stay the fast path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote_plus, unquote_plus

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gleanery.functions.text import WHITE_SPACE

_BROKEN = re.compile(r"%(?![0-9A-Fa-f]{2})")
_URL = re.compile(r"(?s)([^?#]*)(?:\?([^#]*))?(#.*)?")


def _columns(table: AnalyzeArgument, *names: str) -> list:
    """The fields of the given names; anything but a table with them is an error."""
    if not table.isTable:
        raise ValueError("a TABLE argument is needed")
    fields = {f.name: f for f in table.dataType.fields}
    missing = [n for n in names if n not in fields]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return [fields[n] for n in names]


def _with_parameter(url: str, name: str, value: str) -> str:
    base, query, fragment = _URL.fullmatch(url).groups(default="")
    pairs = [(name, 0, value)]
    for i, text in enumerate(p for p in query.split("&") if p and ";" not in p):
        key, _, own = text.partition("=")
        if not _BROKEN.search(text) and unquote_plus(key) != name:
            pairs.append((unquote_plus(key), i, unquote_plus(own)))
    encoded = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, _, v in sorted(pairs))
    return f"{base}?{encoded}{fragment}"


class PaginateTable:
    """One row (source_id, page, url) per page of each source of a table with source_id,
    url and pagination."""

    @staticmethod
    def analyze(sources: AnalyzeArgument) -> AnalyzeResult:
        key, _, _ = _columns(sources, "source_id", "url", "pagination")
        return AnalyzeResult(
            StructType().add("source_id", key.dataType).add("page", IntegerType()).add("url", StringType())
        )

    def eval(self, row: Row) -> Iterator[tuple]:
        rule, url = row["pagination"], row["url"]
        enabled = bool(rule and rule["enabled"])
        first = rule["start_page"] if rule and rule["start_page"] is not None else 1
        # As `greatest`, which leaves a null aside.
        count = max(rule["max_pages"] or 1, 1) if enabled else 1
        for page in range(first, first + count):
            if not enabled or url is None:
                made = url
            elif "${page}" in url:
                made = url.replace("${page}", str(page))
            else:
                made = rule["param_name"] and _with_parameter(url, rule["param_name"], str(page))
            yield row["source_id"], page, made


class ParseRobotsTable:
    """The rules (host, agent, path, allow, pos) of the robots.txt bodies of a table with
    host and body. Rules go to all agents of their group."""

    @staticmethod
    def analyze(bodies: AnalyzeArgument) -> AnalyzeResult:
        host, _ = _columns(bodies, "host", "body")
        schema = StructType().add("host", host.dataType).add("agent", StringType()).add("path", StringType())
        return AnalyzeResult(schema.add("allow", BooleanType()).add("pos", IntegerType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        agents: list[str] = []
        opened = False
        for pos, line in enumerate((row["body"] or "").split("\n")):
            field, colon, value = line.partition("#")[0].partition(":")
            if not colon:
                continue
            field, value = field.lower().strip(WHITE_SPACE), value.strip(WHITE_SPACE)
            if field == "user-agent":
                agents = agents if opened else []
                agents += [value.lower()] if value and value.lower() not in agents else []
            elif field in ("allow", "disallow") and value:
                for agent in agents:
                    yield row["host"], agent, value, field == "allow", pos
            opened = field == "user-agent"


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("glean_paginate_table", udtf(PaginateTable))
    spark.udtf.register("glean_parse_robots_table", udtf(ParseRobotsTable))
