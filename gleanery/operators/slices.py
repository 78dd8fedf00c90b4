"""Ordered per-key computations that survive a key holding much of the data.

A window partitioned by key alone puts all rows of a key into one task. Here the rows are
sorted into ranges of (key, time, ties) first; the range is the slice of its rows. A
key that lies in one range has one slice, and a large key as many as its rows fill,
however its times and ties are spread. Windows run per (key, slice), one summary row per
slice is scanned in order, and its result is carried to the rows of the later slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.session import written

HOT_ROWS = 1_000_000
# Ranges per `hot_rows` rows, to leave room for sampled bounds.
SPREAD = 2


def slice_hot_keys(
    df: DataFrame, key: str, ts: str, tie: str | tuple[str, ...], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add `_hot` and `_slice`, which grows with (ts, *tie) inside a key.

    A slice has at most about `hot_rows` rows, unless more rows are equal in key, time and
    ties. Rows without a key belong together with no other row and are not `_hot`.

    The rows are computed once and written to the shared folder; counting, the sample of
    the ranges, the windows and the summary read them there. Up to `hot_rows` rows are one
    slice as they are. Beyond, the sliced rows are written too, so that their slices stay
    what they are when a task runs again.
    """
    ties = (tie,) if isinstance(tie, str) else tuple(tie)
    rows = written(df, "slice-rows")
    count = rows.count()
    alone = F.col(key).isNull()

    def numbered(dealt: DataFrame, number: Column) -> DataFrame:
        slice_of = F.when(alone, F.xxhash64(ts, *ties)).otherwise(number.cast("bigint"))
        return dealt.withColumn("_hot", ~alone).withColumn("_slice", slice_of)

    if count <= hot_rows:
        return numbered(rows, F.lit(0))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, count * SPREAD // hot_rows + 1)
    dealt = rows.repartitionByRange(ranges, key, ts, *ties)
    return written(numbered(dealt, F.spark_partition_id()), "slices")


def slice_window(key: str, *order: str | Column):
    return Window.partitionBy(key, "_slice", "_hot").orderBy(*order)


def carry_over(
    sliced: DataFrame, key: str, summary: dict[str, Column], carried: dict[str, Column]
) -> DataFrame:
    """Join to each row with a key what the earlier slices of its key left behind.

    `summary` are aggregates per slice; `carried` are expressions over the summary
    columns, evaluated in `earlier_slices(key)` windows. The rows are already
    partitioned by (key, slice), so only the summary rows move for the join. `_hot` is
    part of every key, so that its filter passes below the windows.
    """
    cell = [key, "_slice", "_hot"]
    per_slice = sliced.filter("_hot").groupBy(*cell).agg(
        *(c.alias(name) for name, c in summary.items())
    )
    scanned = per_slice
    for name, c in carried.items():
        scanned = scanned.withColumn(name, c)
    return sliced.join(scanned.select(*cell, *carried), cell, "left")


def earlier_slices(key: str):
    return (
        Window.partitionBy(key)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
