"""Streams of recorded fetches: items, counters, rate audits and sinks."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from gleanery.functions.registry import Registry
from gleanery.operators.aggregates import outcome_rows, outcome_totals, total_stats
from gleanery.operators.limits import DEFAULT_RPM
from gleanery.plans.flow import items_with_errors
from gleanery.session import is_file
from gleanery.sinks.committed import write_batch
from gleanery.sinks.writers import WRITERS


def read_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    max_files: int = 100,
    pattern: str | None = None,
) -> DataFrame:
    """Parquet files as a stream: those of a folder, or the one file that `path` names.
    `max_files` bounds a micro-batch, as a full channel would bound the rows in flight."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if is_file(spark, path):  # streams read folders only
        path, pattern = posixpath.split(path)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path or ".")


def stream_items(
    fetches: DataFrame, sources: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """Items and error rows of arriving fetches: the batch dataflow unchanged, the
    sources being a static side of the join."""
    return items_with_errors(fetches, sources, registry)


def stream_stats(fetches: DataFrame) -> DataFrame:
    """Running fetch counters per source; the state holds one row per source."""
    ok, failed = F.col("error").isNull(), F.col("error").isNotNull()
    return fetches.groupBy("source_id").agg(
        F.count("*").alias("processed_sources"),
        F.count_if(ok).alias("successful_fetches"),
        F.count_if(failed).alias("failed_fetches"),
        F.min("submitted_at").alias("start_time"),
        F.max("fetched_at").alias("end_time"),
    )


def stream_outcomes(fetches: DataFrame, parses: DataFrame) -> DataFrame:
    """Running counters of fetches and parses per source, as `source_stats` counts them.

    Both streams are one table of counters with one state, a row per source, whichever of
    them is ahead; there is no join of streams to wait for. For `update_sink`; the sources
    of `latest_rows` make up the run with `run_of`.
    """
    return outcome_rows(fetches, parses).groupBy("source_id").agg(*outcome_totals())


def run_of(sources: DataFrame, latest: DataFrame) -> DataFrame:
    """The counters of the whole run, as `run_stats` has them, from those of its sources."""
    return total_stats(sources, latest)


def stream_rate_audit(
    requests: DataFrame,
    limits: DataFrame,
    default: int = DEFAULT_RPM,
    watermark: str = "1 hour",
) -> DataFrame:
    """(host, minute) cells above the limit; requests later than the watermark are
    dropped, so the state holds the cells of that time span only."""
    cells = (
        requests.withWatermark("ts", watermark)
        .groupBy("host", F.window("ts", "1 minute").alias("w"))
        .agg(F.count("*").alias("n"))
    )
    return (
        cells.join(limits, "host", "left")
        .withColumn("rpm", F.coalesce("rpm", F.lit(default)))
        .filter("n > rpm")
        .select("host", F.col("w.start").alias("minute"), "n", "rpm")
    )


def stream_sink(
    rows: DataFrame, path: str, checkpoint: str, format: str = "parquet"
) -> DataStreamWriter:
    """Append rows to files exactly once.

    The file sink logs committed files. The report formats have no such log: a micro-batch
    is written aside, moved to its place and then entered in a manifest
    (`sinks.committed`), and `read_committed` reads what is entered there.
    """
    if format in ("parquet", "json", "orc"):
        return (
            rows.writeStream.format(format)
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
        )
    if format not in WRITERS:
        raise ValueError(f"unsupported format: {format}")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id, format)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def update_sink(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Changed rows of an aggregate, one folder per micro-batch (safe to repeat)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each row written by `update_sink`."""
    versions = spark.read.option("basePath", path).parquet(path)
    values = [c for c in versions.columns if c not in (*keys, "batch")]
    return versions.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch").alias("_latest")
    ).select(*keys, "_latest.*")


def run_to_end(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
