import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.functions.registry import Registry
from gleanery.operators import aggregates, limits
from gleanery.plans import flow, views
from gleanery.plans.catalog import QUERIES
from gleanery.streaming import streams

from sample_tables import SF

START = datetime(2024, 1, 1)


@pytest.fixture
def files(spark, tmp_path):
    """Fetches as several files, as they would arrive."""
    path = str(tmp_path / "in")
    fetches = views.bodies(spark, SF).repartition(4, "page_id")
    fetches.write.parquet(path)
    return path, spark.read.parquet(path)



@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """The tables, those that are streamed as folders of several files."""
    base = tmp_path_factory.mktemp("parted")
    for name in os.listdir(SF):
        if name not in ("pages.parquet", "events.parquet"):
            os.symlink(f"{SF}/{name}", base / name)
    for name, key in (("pages", "page_id"), ("events", "event_id")):
        views.read(spark, SF, name).repartition(5, key).write.parquet(f"{base}/{name}.parquet")
    return str(base)


@pytest.mark.parametrize("name", ["stream_containers", "stream_items", "stream_outcomes", "stream_report", "stream_run", "stream_stats"])
def test_queries_over_folders_of_files(spark, parted, name):
    one, many = (QUERIES[name](spark, sf) for sf in (SF, parted))
    want = rows_of(one, *one.columns)
    assert rows_of(many, *one.columns) == want and want


def read_schema(spark, path, max_files=1):
    schema = spark.read.parquet(path).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return streams.read_stream(spark, path, ddl, max_files)


def rows_of(frame, *names):
    return sorted((tuple(str(r[n]) for n in names) for r in frame.collect()))


def test_items_equal_batch(spark, files, tmp_path):
    path, batch = files
    sources = views.sources(spark, SF)
    flowing = streams.stream_items(read_schema(spark, path), sources)
    assert flowing.isStreaming
    streams.run_to_end(streams.stream_sink(flowing, f"{tmp_path}/out", f"{tmp_path}/check"))
    names = ("page_id", "item_no", "title", "url", "content", "error", "extracted_by")
    got = rows_of(spark.read.parquet(f"{tmp_path}/out"), *names)
    assert got == rows_of(flow.items_with_errors(batch, sources), *names)
    assert any("HTTP error" in r[5] for r in got) and any("no parser" in r[5] for r in got)


def test_registered_extractor_in_a_stream(spark, files, tmp_path):
    path, _ = files
    known = Registry()
    known.register_extractor("pdf", lambda d: d.select("page_id", F.lit("p").alias("title"), F.lit("pdf").alias("extracted_by")))
    flowing = streams.stream_items(read_schema(spark, path), views.sources(spark, SF), known)
    streams.run_to_end(streams.stream_sink(flowing, f"{tmp_path}/out", f"{tmp_path}/check"))
    rows = spark.read.parquet(f"{tmp_path}/out").filter("extracted_by = 'pdf'")
    assert rows.count() > 0 and {r.title for r in rows.collect()} == {"p"}


def test_stats_equal_batch(spark, files, tmp_path):
    path, batch = files
    counters = streams.stream_stats(read_schema(spark, path))
    streams.run_to_end(streams.update_sink(counters, f"{tmp_path}/out", f"{tmp_path}/check"))
    names = ("source_id", "processed_sources", "successful_fetches", "failed_fetches", "start_time", "end_time")
    got = rows_of(streams.latest_rows(spark, f"{tmp_path}/out", ["source_id"]), *names)
    no_parses = batch.limit(0).select("source_id", "error")
    assert got == rows_of(aggregates.source_stats(batch, no_parses), *names)


def test_sink_adds_nothing_after_a_restart(spark, files, tmp_path):
    path, batch = files
    for n in (1, 2, 3):
        rows = read_schema(spark, path).select("page_id", "error")
        streams.run_to_end(streams.stream_sink(rows, f"{tmp_path}/out", f"{tmp_path}/check"))
        if n == 2:
            batch.limit(5).select(*(F.col(c) for c in batch.columns)).write.mode("append").parquet(path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count() + 5


def test_report_format_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(6).select(
        F.array(F.concat(F.lit("c"), "id")).alias("contents"), F.array().cast("array<string>").alias("errors")
    ).repartition(3).write.parquet(path)
    for _ in range(2):
        sink = streams.stream_sink(read_schema(spark, path), f"{tmp_path}/out", f"{tmp_path}/check", "csv")
        streams.run_to_end(sink)
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert sorted(r.Content for r in rows.collect()) == [f"c{i}" for i in range(6)]
    with pytest.raises(ValueError, match="unsupported format"):
        streams.stream_sink(read_schema(spark, path), "x", "y", "yaml")


def test_rate_audit_equals_batch_and_drops_late_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"h{rng.randrange(3)}", START + timedelta(seconds=i * 2)) for i in range(600)]
    frame = spark.createDataFrame(rows, "id bigint, host string, ts timestamp")
    lim = spark.createDataFrame([("h0", 5)], "host string, rpm int")
    path = str(tmp_path / "in")
    frame.repartition(3, "id").write.parquet(path)
    found = streams.stream_rate_audit(read_schema(spark, path), lim, default=9)
    streams.run_to_end(streams.update_sink(found, f"{tmp_path}/out", f"{tmp_path}/check"))
    names = ("host", "minute", "n", "rpm")
    want = rows_of(limits.rate_audit(frame, lim, default=9), *names)
    assert rows_of(streams.latest_rows(spark, f"{tmp_path}/out", ["host", "minute"]), *names) == want
    # The watermark has passed; a burst an hour late changes nothing.
    late = [(1000 + i, "h0", START - timedelta(hours=2)) for i in range(50)]
    spark.createDataFrame(late, frame.schema).write.mode("append").parquet(path)
    found = streams.stream_rate_audit(read_schema(spark, path), lim, default=9)
    streams.run_to_end(streams.update_sink(found, f"{tmp_path}/out", f"{tmp_path}/check"))
    assert rows_of(streams.latest_rows(spark, f"{tmp_path}/out", ["host", "minute"]), *names) == want


def _arrive(spark, frame, path, number):
    frame.coalesce(1).write.mode("append").parquet(path)


def test_outcomes_of_two_streams_over_a_restart(spark, tmp_path):
    """Files of both streams arrive apart; the counters equal the batch after the last file."""
    fetched, parsed = views.fetches(spark, SF), views.parses(spark, SF)
    f_path, p_path, base = f"{tmp_path}/f", f"{tmp_path}/p", str(tmp_path)
    for part in range(4):
        if part < 3:
            _arrive(spark, fetched.where(f"page_id % 3 = {part}"), f_path, part)
        if part > 0:
            _arrive(spark, parsed.where(f"page_id % 3 = {part - 1}"), p_path, part)
        else:
            _arrive(spark, parsed.limit(0), p_path, part)
        counters = streams.stream_outcomes(read_schema(spark, f_path), read_schema(spark, p_path))
        streams.run_to_end(streams.update_sink(counters, f"{base}/out", f"{base}/check"))
    latest = streams.latest_rows(spark, f"{base}/out", ["source_id"])
    want = aggregates.source_stats(fetched, parsed)
    assert rows_of(latest, *want.columns) == rows_of(want, *want.columns)
    sources = views.sources(spark, SF)
    whole = aggregates.run_stats(sources, fetched, parsed)
    assert rows_of(streams.run_of(sources, latest), *whole.columns) == rows_of(whole, *whole.columns)


REPORTS = {
    "csv": lambda spark, folders: spark.read.option("header", True).csv(folders).select(F.col("Content").alias("c")),
    "xml": lambda spark, folders: spark.read.format("xml").schema("contents array<string>").option("rowTag", "result").load(folders).select(F.get("contents", F.lit(0)).alias("c")),
    "html": lambda spark, folders: spark.read.text(folders).select(F.regexp_extract("value", "<p>(.*)</p>", 1).alias("c")).where("c <> ''"),
}


@pytest.mark.parametrize("format", sorted(REPORTS))
def test_reports_show_committed_batches_only(spark, tmp_path, monkeypatch, format):
    """A batch is killed while it is written, and once it is written but not entered. Readers
    see none of it, and the restart completes it, without a row twice."""
    from gleanery.sinks import committed

    path, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    schema = "contents array<string>, errors array<string>"
    for n in range(3):
        rows = spark.createDataFrame([([f"b{n}r{k}"], []) for k in range(5)], schema)
        rows.coalesce(1).write.mode("append").parquet(path)

    def run():
        sink = streams.stream_sink(read_schema(spark, path), out, check, format=format)
        streams.run_to_end(sink)

    def seen():
        found = committed.read_committed(spark, out, lambda folders: REPORTS[format](spark, folders))
        return sorted(r.c for r in found.collect()) if found is not None else []

    write = committed.WRITERS[format]

    def dies(batch, target, mode):
        write(batch, target, mode)
        if target.endswith("/1"):
            raise RuntimeError("killed")

    monkeypatch.setitem(committed.WRITERS, format, dies)
    with pytest.raises(Exception, match="killed"):
        run()
    assert committed.committed_batches(spark, out) == [0] and len(seen()) == 5
    assert not list((tmp_path / "out").glob("_staging/*")) and not list((tmp_path / "out").glob("batch=1*"))

    monkeypatch.setitem(committed.WRITERS, format, write)
    touch = committed._Files.touch
    monkeypatch.setattr(committed._Files, "touch", lambda self, entry: touch(self, entry) if not entry.endswith("/2") else 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError|division by zero"):
        run()
    assert committed.committed_batches(spark, out) == [0, 1] and len(seen()) == 10
    monkeypatch.setattr(committed._Files, "touch", touch)
    run()
    run()
    assert committed.committed_batches(spark, out) == [0, 1, 2]
    assert seen() == sorted(f"b{n}r{k}" for n in range(3) for k in range(5))
