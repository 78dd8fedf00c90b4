import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from gleanery.operators import limits
from gleanery.operators.slices import slice_hot_keys

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def traffic():
    """Requests of which one host holds most, with bursts and equal times."""
    rng = random.Random(11)
    rows, now = [], 0.0
    for i in range(900):
        now += rng.choice([0, 0, 0.25, 1, 9])
        host = rng.choice(["hot"] * 5 + ["a", "b", None])
        rows.append((i, host, at(now), 8 if host == "hot" else 3))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("spread", ["burst", "equal"])
def test_crowded_slices_are_cut_again(spark, spread):
    """A hot key with nearly all rows at one instant, or in a short burst."""
    rows = []
    for i in range(2000):
        micros = 0 if spread == "equal" else i % 700
        rows.append((i, "hot", START + timedelta(microseconds=micros), 6))
    rows += [(3000, "hot", at(86400), 6), (3001, "cold", at(5), 6)]
    frame = spark.createDataFrame(rows, "id bigint, host string, ts timestamp, rpm int")
    sliced = slice_hot_keys(frame, "host", "ts", "id", hot_rows=100)
    sizes = [r["count"] for r in sliced.groupBy("host", "_slice").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 100
    ordered = [r._slice for r in sliced.filter("host = 'hot'").orderBy("ts", "id").collect()]
    assert ordered == sorted(ordered)
    got = {r.id: r.release_ts for r in limits.token_bucket_schedule(frame, key="host", hot_rows=100).collect()}
    hot = sorted((ts, i) for i, host, ts, _ in rows if host == "hot")
    micros = [round((ts - START).total_seconds() * 1e6) for ts, _ in hot]
    for (_, i), want in zip(hot, replay(micros, 10_000_000, 6)):
        assert round((got[i] - START).total_seconds() * 1e6) == want


def replay(times, token, capacity):
    """Sequential bucket: continuous refill, first come first served."""
    level, last, released = capacity * token, None, []
    for t in times:
        now = t if last is None else max(t, last)
        if last is not None:
            level = min(capacity * token, level + now - last)
        if level < token:
            now += token - level
            level = token
        level -= token
        last = now
        released.append(now)
    return released


@pytest.mark.parametrize("hot_rows", [10**6, 60])
@pytest.mark.parametrize("capacity", [None, 3])
def test_bucket_against_replay(spark, traffic, hot_rows, capacity):
    frame = spark.createDataFrame(traffic, "id bigint, host string, ts timestamp, rpm int")
    planned = limits.token_bucket_schedule(frame, key="host", capacity=capacity, hot_rows=hot_rows)
    got = {r.id: r for r in planned.collect()}
    assert len(got) == len(traffic)
    by_host = defaultdict(list)
    for i, host, ts, rpm in traffic:
        by_host[host if host else ("none", i)].append((round((ts - START).total_seconds() * 1e6), i, rpm))
    delayed = 0
    for rows in by_host.values():
        rows.sort()
        rpm = rows[0][2]
        released = replay([t for t, _, _ in rows], 60_000_000 // rpm, capacity or rpm)
        for (t, i, _), want in zip(rows, released):
            assert round((got[i].release_ts - START).total_seconds() * 1e6) == want
            assert got[i].wait_ms == (want - t) // 1000
            delayed += want > t
    assert delayed > 50


@pytest.mark.parametrize("hot_rows", [10**6, 60])
def test_crawl_delay(spark, traffic, hot_rows):
    frame = spark.createDataFrame([r[:3] for r in traffic], "id bigint, host string, ts timestamp")
    delays = spark.createDataFrame([("hot", 1)], "host string, delay_s int")
    found = limits.crawl_delay_audit(frame, delays, default_ms=9000, hot_rows=hot_rows).collect()
    want, last = set(), {}
    for i, host, ts, _ in sorted(traffic, key=lambda r: (r[2], r[0])):
        wait = timedelta(seconds=1 if host == "hot" else 9)
        if host and host in last and ts - last[host] < wait:
            want.add(i)
        last[host] = ts
    assert {r.id for r in found} == want and len(found) == len(want) > 100


@pytest.mark.parametrize("hot_rows", [10**6, 60])
def test_retries(spark, traffic, hot_rows):
    errors = ["dial: TIMEOUT", "Connection refused", "not found", None]
    rows = [(i, host or "x", ts, errors[i % 4]) for i, host, ts, _ in traffic]
    frame = spark.createDataFrame(rows, "id bigint, url string, ts timestamp, error string")
    planned = limits.retry_schedule(frame, {"max_retries": 6, "max_ms": 900}, hot_rows=hot_rows).collect()
    got, count = {r.id: r for r in planned}, defaultdict(int)
    assert len(planned) == sum(r[3] is not None for r in rows)
    for i, url, ts, error in sorted(rows, key=lambda r: (r[2], r[0])):
        if error is None:
            continue
        count[url] += 1
        n, r = count[url], got[i]
        again = error != "not found" and n < 6
        assert (r.attempt, r.retryable, r.give_up) == (n, error != "not found", not again)
        assert r.delay_ms == (min(100 * 2 ** (n - 1), 900) if again else None)
        assert r.next_at == (ts + timedelta(milliseconds=r.delay_ms) if again else None)


def test_domain_limit(spark):
    sources = spark.createDataFrame(
        [("https://a/x", 0, 0), ("https://a/y", 12, 1), ("https://a/z", 50, 2), ("https://b", None, 3)],
        "url string, rpm int, pos bigint",
    )
    urls = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "host string")
    found = {r.host: r.rpm for r in limits.domain_rate_limit(urls, sources).collect()}
    assert found == {"a": 12, "b": 30, "c": 30, None: 30}


def test_rate_audit(spark):
    rows = [(i, "a", at(i)) for i in range(70)] + [(i, "b", at(i * 2)) for i in range(40)]
    frame = spark.createDataFrame(rows, "id bigint, host string, ts timestamp")
    lim = spark.createDataFrame([("a", 59)], "host string, rpm int")
    found = [tuple(r) for r in limits.rate_audit(frame, lim, default=30).collect()]
    assert found == [("a", at(0), 60, 59)]


def test_rates_that_are_null_or_zero_take_the_default(spark):
    rows = [(i, "h", at(0), r) for i, r in enumerate([0, None, -1] * 20)]
    frame = spark.createDataFrame(rows, "id bigint, host string, ts timestamp, rpm int")
    waits = sorted(r.wait_ms for r in limits.token_bucket_schedule(frame, key="host").collect())
    assert waits == [0] * 30 + [2000 * k for k in range(1, 31)]


def test_order_of_several_columns(spark):
    rows = [(1, 2**33, 0), (0, 0, 70_000), (0, 1, 0), (1, 5, 0)]
    frame = spark.createDataFrame(rows, "priority bigint, pos bigint, page bigint").selectExpr(
        "*", "-priority AS turn", "'h' AS host", "timestamp'2024-01-01' AS ts", "1 AS rpm"
    )
    planned = limits.token_bucket_schedule(frame, key="host", tie=("turn", "pos", "page"))
    found = [(r.priority, r.pos, r.page) for r in planned.orderBy("release_ts").collect()]
    assert found == [(1, 5, 0), (1, 2**33, 0), (0, 0, 70_000), (0, 1, 0)]
