"""Joins of many rows with a lookup table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from gleanery.session import written

MAX_ROWS = 500_000
MAX_BYTES = 64 * 1024 * 1024


def fits_broadcast(table: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure a table: at most `max_rows + 1` row sizes are looked at."""
    sizes = table.select(F.length(F.to_json(F.struct("*"))).alias("n")).limit(max_rows + 1)
    rows, size = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def is_computed(table: DataFrame) -> bool:
    """Whether a table takes more than a scan, a projection and a filter."""
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.search(r"^[ :+-]*(?:Aggregate|Join|Window|Sort|Generate|Repartition|Union|\w*Python|MapIn|FlatMap)", plan, re.M))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str | list[str],
    how: str = "inner",
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Join `table` (one row per key) to `rows`.

    A table measured to be small is broadcast, so the rows are not shuffled. The planner
    cannot see this itself for a derived table: it would learn the size only after
    it had shuffled the rows. A computed table is written first, so that it is computed once
    for its measure and the join. A larger table is hash-joined per partition, without a
    sort of the rows; adaptive execution splits the partitions of a skewed key.
    """
    if is_computed(table):
        table = written(table, "lookup")
    small = fits_broadcast(table, max_rows, max_bytes)
    return rows.join(F.broadcast(table) if small else table.hint("shuffle_hash"), key, how)
