import random
from datetime import datetime, timedelta

import pytest

from gleanery.operators import robots

BODY = """# comment
Disallow: /before
User-agent: *
Disallow: /private # tail
Allow: /private/open
Disallow: /tmp*
Disallow:
no colon here

User-Agent: BotA
USER-AGENT:  BotB
Disallow: /b
Crawl-delay: 0
crawl-delay: 7
Crawl-delay: soon
Sitemap: https://h/s.xml
User-agent: Quiet
Disallow:
sitemap:
"""


@pytest.fixture
def bodies(spark):
    return spark.createDataFrame([("h", BODY), ("empty", "")], "host string, body string")


def test_rules(bodies):
    found = sorted((r.agent, r.path, r.allow, r.pos) for r in robots.parse_robots(bodies).collect())
    assert found == [
        ("*", "/private", False, 3), ("*", "/private/open", True, 4), ("*", "/tmp*", False, 5),
        ("bota", "/b", False, 11), ("botb", "/b", False, 11),
    ]
    assert [tuple(r) for r in robots.robots_sitemaps(bodies).collect()] == [("h", "https://h/s.xml")]
    delays = {r.host: r.delay_s for r in robots.robots_crawl_delay(bodies).collect()}
    assert delays == {"h": 7, "empty": None}


@pytest.mark.parametrize(
    "agent, url, allowed",
    [
        ("other", "https://h/private/x", False),
        ("other", "https://h/private/open/x", True),
        ("other", "https://h/tmpfile", False),
        ("other", "https://h", True),
        ("other", "https://empty/private", True),
        ("other", "https://unknown/private", True),
        ("BOTA", "https://h/private", True),
        ("botb", "https://h/b?q", False),
        ("quiet", "https://h/private", True),
    ],
)
def test_verdicts(spark, bodies, agent, url, allowed):
    urls = spark.createDataFrame([(url,)], "url string")
    assert robots.robots_allowed(urls, bodies, agent).first().allowed is allowed


def test_query_and_ties(spark):
    body = "User-agent: *\nDisallow: /p?x=1\nAllow: /q\nDisallow: /q*\n"
    bodies = spark.createDataFrame([("h", body)], "host string, body string")
    urls = spark.createDataFrame([("https://h/p?x=1",), ("https://h/p",), ("https://h/q",)], "url string")
    found = {r.url: r.allowed for r in robots.robots_allowed(urls, bodies, "x").collect()}
    # Equal length: the earlier rule wins.
    assert found == {"https://h/p?x=1": False, "https://h/p": True, "https://h/q": True}


def test_status(spark):
    rows = spark.createDataFrame(
        [("a", 200, "b"), ("b", 404, "b"), ("c", 503, "b"), ("d", None, None)], "host string, status int, body string"
    )
    found = {r.host: (r.body, r.warning) for r in robots.robots_status_policy(rows).collect()}
    assert found == {
        "a": ("b", None), "b": ("", None),
        "c": ("", "received status code 503"), "d": ("", "received status code none"),
    }


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_asof_against_brute_force(spark, hot_rows):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    # Host 0 holds most rows; many times are equal.
    hosts = [0] * 6 + [1, 2, None]
    requests = [(i, f"h{h}" if (h := rng.choice(hosts)) is not None else None, at(rng.randrange(300))) for i in range(400)]
    snapshots = [(f"h{rng.choice([0, 1])}", at(rng.randrange(300)), v) for v in range(40)]
    found = robots.robots_asof(
        spark.createDataFrame(requests, "id bigint, host string, ts timestamp"),
        spark.createDataFrame(snapshots, "host string, fetched_at timestamp, version bigint"),
        ttl_seconds=40,
        hot_rows=hot_rows,
    ).collect()
    assert len(found) == len(requests)
    got = {r.id: r.robots_version for r in found}
    for i, host, ts in requests:
        before = [(f, v) for h, f, v in snapshots if h == host and f <= ts]
        newest = max(before, default=None)
        fresh = newest and ts < newest[0] + timedelta(seconds=40)
        assert got[i] == (newest[1] if fresh else None)
