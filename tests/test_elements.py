"""Selectors with combinators over the intervals of a page."""

import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gleanery.functions.elements import UnreadableSelector, elements, needs_elements, parse_selector, read_items

PAGE = """<!DOCTYPE html><html><body id="top">
<div class="a b"><p>one</p><p class="x">two</p><ul><li>1<li>2<li>3</ul><span>s</span><p>three</div>
<div><section><p lang="en-GB" data-k="say, hi">four</p></section><a href="/q?a=1">link</a></div>
<script>var x = "<p>no</p>"</script><!-- <p>hidden</p> -->
<table><tr><td>a<td>b<tr><td>c<td>d</table><br/><p>after</p></body></html>"""


def texts(selector, page=PAGE):
    table = elements(page)
    found = []
    for path in parse_selector(selector):
        for k in path.matched(table):
            value = table[k].attributes().get(path.attribute) if path.attribute else page[table[k].inner : table[k].inner_end]
            found.append(value)
    return found


@pytest.mark.parametrize(
    "selector, want",
    [
        ("div p", ["one", "two", "three", "four"]),
        ("div > p", ["one", "two", "three"]),
        ("li:nth-child(2)", ["2"]),
        ("p:first-child", ["one", "four"]),
        ("li:last-child", ["3"]),
        ("li:nth-child(odd)", ["1", "3"]),
        ("li:nth-child(-n+2)", ["1", "2"]),
        ("li:nth-child(n + 2)", ["2", "3"]),
        ("li:nth-last-child(1)", ["3"]),
        ("p:nth-of-type(2)", ["two"]),
        ("p:last-of-type", ["three", "four", "after"]),
        ("section > p:only-child", ["four"]),
        ("p + p", ["two"]),
        ("ul ~ p", ["three"]),
        ("ul + span", ["s"]),
        (".a.b > .x", ["two"]),
        ("#top > p", ["after"]),
        ("body div section p", ["four"]),
        ("section a", []),
        ("div > a@href", ["/q?a=1"]),
        ("[data-k='say, hi']", ["four"]),
        ("[lang|=en]", ["four"]),
        ("a[href^='/q']", ["link"]),
        ("a[href$='1'], a[href*='?a']", ["link", "link"]),
        ("div[class~=b] * li:first-child", ["1"]),
        ("div[class~=b] * * li", []),
        ("div[class~=b] li:first-child", ["1"]),
        ("tr:nth-child(2) td:first-child", ["c"]),
        ("td + td", ["b", "d"]),
        ("*:first-child > p", ["one", "two", "three", "four", "after"]),
    ],
)
def test_selectors(selector, want):
    assert [v.strip() for v in texts(selector)] == want


@pytest.mark.parametrize("selector", ["", "p:hover", "div >", "> p", "p,,a", "p:nth-child(x)", "p::before", "a[", "p:not(.x)", "p || q", "a@"])
def test_unreadable(selector):
    with pytest.raises(UnreadableSelector, match="unreadable selector: "):
        parse_selector(selector)


def _plain(table, steps, k):
    """Whether element k matches, by trying every ancestor and sibling."""
    combinator, compound = steps[-1]
    if not compound.matches(table, table[k]):
        return False
    if len(steps) == 1:
        return True
    parent = table[k].parent
    if combinator == ">":
        places = [parent]
    elif combinator == " ":
        places, at = [], parent
        while at >= 0:
            places.append(at)
            at = table[at].parent
    else:
        before = [i for i in range(1, k) if table[i].parent == parent]
        places = before[-1:] if combinator == "+" else before
    return any(p > 0 and _plain(table, steps[:-1], p) for p in places)


TAGS = st.sampled_from(["<a>", "</a>", "<b>", "</b>", "<p>", "</p>", "<div class='x'>", "</div>", "<li>", "<ul>", "</ul>", "<br>", "t"])
COMPOUNDS = st.sampled_from(["a", "b", "p", ".x", "*", "li:first-child", "div:nth-child(2n)", "ul"])


@settings(max_examples=150, deadline=None)
@given(st.lists(TAGS, max_size=40), st.lists(COMPOUNDS, min_size=1, max_size=4), st.lists(st.sampled_from([" ", " > ", " + ", "~"]), min_size=3, max_size=3))
def test_against_every_ancestor(tags, compounds, joins):
    table = elements("".join(tags))
    selector = compounds[0] + "".join(j + c for j, c in zip(joins, compounds[1:]))
    (path,) = parse_selector(selector)
    assert path.matched(table) == [k for k in range(1, len(table)) if _plain(table, path.steps, k)]
    for k, element in enumerate(table[1:], 1):
        parent = table[element.parent]
        assert parent.inner <= element.start <= element.inner <= element.inner_end <= parent.inner_end


def test_nested_items():
    page = "<div class=i><h2>A</h2><div class=i><h2> </h2><h3>B</h3></div><h2>late</h2></div><div class=i></div><h2>none</h2>"
    fields = {"container": parse_selector("div.i"), "title": parse_selector("h2, h3")}
    assert read_items(page, fields) == [[("title", ["A"])], [("title", [" ", "B"])], []]
    del fields["container"]
    assert read_items(page, fields, every=True) == [[("title", ["A", " ", "late", "none", "B"])]]


@pytest.mark.parametrize(
    "page", ["<div>" * 60_000, "<li><ul>" + "<div>" * 30_000 + "<li>" * 30_000, "<p" * 60_000, '<a "' * 60_000, "<a x='" * 60_000, "</b>" * 60_000, "<!--" * 60_000]
)
def test_linear_in_the_page(page):
    began = time.process_time()
    fields = {"container": parse_selector("div div > li"), "title": parse_selector("div ~ li + li a")}
    read_items(page, fields)
    assert time.process_time() - began < 5


def test_which_selectors_need_the_table(spark):
    cases = [
        ({"title": "h1, .a, #b, [c], a[d='e']@f"}, False), ({"title": "div p"}, True), ({"title": "li:first-child"}, True),
        ({"container": "article", "title": "h1"}, True), ({"title": "a.b.c"}, True), ({}, False), (None, False),
    ]
    rows = spark.createDataFrame([(k, m, w) for k, (m, w) in enumerate(cases)], "k int, m map<string,string>, want boolean")
    assert rows.where(needs_elements(F.col("m")) != F.col("want")).count() == 0
