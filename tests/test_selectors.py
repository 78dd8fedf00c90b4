import pytest
from pyspark.sql import functions as F

from gleanery.functions.selectors import (
    all_matches,
    compiled_patterns,
    first_match,
    matched_fields,
)

PAGE = """<html><head><title>The &amp; title</title>
<meta name="description" content="About 'it'"></head><body id=top>
<div class="lead big">Lead <b>text</b></div><div class='leader'>no</div>
<span id="by">Ann</span><a class="more" href="/m?x=1">more</a><a href='/n'>n</a>
<time datetime="2024-01-02">2 Jan</time><img src=/i.png alt=x><IMG alt="y" src="/j.png"/>
<pre>pre</pre><p>para</p><a>none</a></body></html>"""


@pytest.mark.parametrize(
    "field, selector, value",
    [
        ("title", "title", "The & title"),
        ("title", "div.lead", "Lead text"),
        ("title", ".big", "Lead text"),
        ("author", "#by", "Ann"),
        ("author", "span#by", "Ann"),
        ("date", "[datetime]", "2 Jan"),
        ("date", "time@datetime", "2024-01-02"),
        ("date", "time[datetime=2024-01-02]", "2 Jan"),
        ("title", "meta[name=description]@content", "About 'it'"),
        ("url", "a.more", "/m?x=1"),
        ("title", "p", "para"),
        ("title", ".lea", None),
        ("title", ".missing, h1, #by", "Ann"),
        ("content", "div.lead", "Lead <b>text</b>"),
    ],
)
def test_selectors(one, field, selector, value):
    assert one(first_match(field, F.col("h"), selector), h=PAGE) == value
    selectors = F.create_map(F.lit(field), F.lit(selector))
    per_row = matched_fields(F.col("h"), compiled_patterns(selectors))
    assert one(per_row, h=PAGE) == {field: value}


def test_unclosed_elements(one):
    page = "<meta name=d><p>one<p>two<br>"
    assert one(first_match("title", F.col("h"), "p"), h=page) == "one two"
    assert one(first_match("title", F.col("h"), "meta[name=d], br"), h=page) is None
    many = "<p>x" * 100_000
    assert one(F.size(all_matches("tags", F.col("h"), "p")), h=many) == 1


def test_lists(one):
    assert one(all_matches("links", F.col("h"), "a"), h=PAGE) == ["/m?x=1", "/n"]
    assert one(all_matches("images", F.col("h"), "img"), h=PAGE) == ["/i.png", "/j.png"]
    assert one(all_matches("tags", F.col("h"), "a, p"), h=PAGE) == ["more", "n", "none", "para"]
