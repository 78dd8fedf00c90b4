from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gleanery.functions import collections as coll
from gleanery.functions import dates, text, urls


@pytest.mark.parametrize(
    "raw, trimmed",
    [
        ("  a b ", "a b"),
        ("\t\n a \r\n", "a"),
        ("\xa0a\xa0", "a"),
        ("　a ", "a"),
        ("\x85\x0ba\x0c", "a"),
        (" \t ", ""),
        ("", ""),
    ],
)
def test_trim(one, raw, trimmed):
    assert one(text.trim_text(F.col("c")), c=raw) == trimmed


@pytest.mark.parametrize(
    "raw, visible",
    [
        ("<p>a<b>b</b></p>", "a b"),
        ("x<script>var t='</p>';</script>y", "x y"),
        ("<STYLE type=a>p{}</STYLE >z<!-- c\n<b> -->w", "z w"),
        ("a &lt;b&gt; &amp;amp; &amp;lt; &quot;q&quot; &#39;s&apos;&nbsp;e", "a <b> &amp; &lt; \"q\" 's' e"),
        ("&copy; & &unknown;", "© & &unknown;"),
        ("1 < 2 <b>and</b> 3 > 2", "1 < 2 and 3 > 2"),
        ("a<script>never closed <p>", "a"),
        ("a<!-- open", "a"),
        ("a <b never closed", "a"),
        ("", ""),
    ],
)
def test_strip_html(one, raw, visible):
    assert one(text.strip_html(F.col("c")), c=raw) == visible


def test_whole_text_is_stripped(one):
    long = "<p>word </p>" * 50_000
    assert one(F.length(text.strip_html(F.col("c"))), c=long) == 50_000 * 5 - 1


def test_truncate_counts_characters(one):
    assert one(text.truncate_text(F.col("c"), 3), c="äßçd") == "äßç"


def test_first_non_empty(one):
    chosen = text.first_non_empty(F.col("a"), F.col("b"), F.lit("z"))
    assert one(chosen, a="  ", b=" x ") == "x"


@pytest.mark.parametrize("extra", [0, 30])
def test_contains_any(one, extra):
    words = ["c++", "go.", "\\E"] + [f"filler{i}" for i in range(extra)]
    hit = text.contains_any([F.col("c")], words)
    assert one(hit, c="I like C++ ")
    assert one(hit, c="Go. now")
    assert one(hit, c="a \\e b")
    assert not one(hit, c="cpp gox")
    assert not one(hit, c="")


@pytest.mark.parametrize(
    "raw, parsed",
    [
        ("2024-01-02", datetime(2024, 1, 2)),
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05+02:00", datetime(2024, 1, 2, 1, 4, 5)),
        ("2024-01-02T03:04:05.120Z", datetime(2024, 1, 2, 3, 4, 5, 120000)),
        ("Tue, 02 Jan 2024 03:04:05 GMT", datetime(2024, 1, 2, 3, 4, 5)),
        ("2 Jan 2024 03:04:05 -0100", datetime(2024, 1, 2, 4, 4, 5)),
        ("2024-13-40", None),
        ("soon", None),
        ("", None),
        ("01 Jan 24 10:00:00 GMT", datetime(2024, 1, 1, 10)),
        ("01 Jan 50 10:00 GMT", datetime(1950, 1, 1, 10)),
        ("Mon, 01 Jan 2024 10:00 GMT", datetime(2024, 1, 1, 10)),
        ("Monday, 1 Jan 2024 10:00:00", datetime(2024, 1, 1, 10)),
        ("Mon, 01 Jan 2024 10:00:00 est", datetime(2024, 1, 1, 15)),
        ("Mon, 01 Jan 2024 10:00:00 Z", datetime(2024, 1, 1, 10)),
        ("1 Jan 2024 10:00 +0130", datetime(2024, 1, 1, 8, 30)),
        ("2024-01-01T10:00:00", datetime(2024, 1, 1, 10)),
        ("2024-01-01 10:00:00", datetime(2024, 1, 1, 10)),
        ("2024-01-01 10:00", datetime(2024, 1, 1, 10)),
        ("2024-01-01T10:00:00.12Z", datetime(2024, 1, 1, 10, 0, 0, 120000)),
        ("2024-01-01t10:00:00.123456789z", datetime(2024, 1, 1, 10, 0, 0, 123456)),
        ("2024-01-01T10:00:00+0200", datetime(2024, 1, 1, 8)),
    ],
)
def test_parse_date(one, raw, parsed):
    seconds = F.unix_micros(dates.parse_date(F.col("c")))
    expected = None if parsed is None else int((parsed - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert one(seconds, c=raw) == expected


@pytest.mark.parametrize(
    "url, parts",
    [
        ("https://a.example:8080/p?q=1#f", ("https", "a.example:8080", "/p", "q=1")),
        ("HTTP://user:pw@h", ("http", "h", "/", None)),
        ("https://h/list?p=${page}", ("https", "h", "/list", "p=${page}")),
        ("https://h/a b", ("https", "h", "/a b", None)),
        ("/only/path", ("", None, "/only/path", None)),
    ],
)
def test_url_parts(one, url, parts):
    assert tuple(one(urls.url_parts(F.col("u")), u=url)) == parts


def test_template(one):
    rendered = urls.render_url_template(F.col("u"), F.lit(date(2024, 5, 6)))
    assert one(rendered, u="h/${page}/${date}/${page}") == "h/1/2024-05-06/1"
    assert one(rendered, u="h/plain") == "h/plain"


@pytest.mark.parametrize(
    "url, enabled, expected",
    [
        ("https://h/a", False, "https://h/a"),
        ("https://h/a?p=${page}", True, "https://h/a?p=3"),
        ("https://h/a", True, "https://h/a?page=3"),
        ("https://h/a?z=1&page=9&b=x%20y&b=2#top", True, "https://h/a?b=x+y&b=2&page=3&z=1#top"),
        ("https://h/a?bad=%zz&ok&&x=~*", True, "https://h/a?ok=&page=3&x=~%2A"),
        ("https://h/a?q=a=b", True, "https://h/a?page=3&q=a%3Db"),
    ],
)
def test_url_with_page(one, url, enabled, expected):
    paged = urls.url_with_page(F.col("u"), F.lit(3), F.lit(enabled), F.lit("page"))
    assert one(paged, u=url) == expected


def test_headers(one):
    given = F.create_map(F.lit("USER-agent"), F.lit("mine"), F.lit("Accept"), F.lit("x"))
    assert one(coll.effective_headers(given)) == {"user-agent": "mine", "accept": "x"}
    none = F.lit(None).cast("map<string,string>")
    assert one(coll.effective_headers(none)) == {"user-agent": coll.DEFAULT_USER_AGENT}


def test_collections(one):
    absent = F.lit(None).cast("array<string>")
    assert one(coll.append_values(absent, F.lit("a"), F.lit("a"))) == ["a", "a"]
    both = coll.put_metadata(F.create_map(F.lit("k"), F.lit("old")), F.lit("k"), F.lit("new"))
    assert one(both) == {"k": "new"}
    assert one(coll.put_metadata(F.lit(None).cast("map<string,string>"), F.lit("k"), F.lit("v"))) == {"k": "v"}
    words = F.array(F.lit("TECH"), F.lit("Prog"), F.lit("technical"))
    assert one(coll.normalize_categories(words)) == ["technology", "programming", "technical"]
    assert one(coll.default_type(F.lit(""))) == "other"


def test_extra_fields(one):
    record = F.create_map(F.lit("name"), F.lit("n"), F.lit("cost"), F.lit("3"))
    pairs = {"title": "name", "price": "cost", "gone": "nothing", "container": "c"}
    mappings = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    assert one(coll.extra_fields(record, mappings)) == {"price": "3"}
