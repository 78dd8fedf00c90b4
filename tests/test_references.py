"""Character references against the standard table."""

import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from gleanery.functions.sql_names import register_all
from gleanery.functions.text import decode_entities

NUMBERS = [0, 1, 8, 9, 10, 11, 13, 14, 31, 32, 65, 127, 128, 129, 150, 159, 160, 8364, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 10**12, 10**30]
TEXTS = [
    *(f"a&{name}b" for name in html5),
    *(f"&{name}&{name};;" for name in html5),
    *(f"x&#{n};y&#{n}z&#x{n:x};&#X{n:X} &#000{n};" for n in NUMBERS),
    "&", "&&", "& ", "&;", "&#;", "&#x;", "&#xg;", "&unknown;", "&unknown", "&notit;", "&notin;", "&ampx", "&amp;lt;", "a & b", "&AMP", "&lt&gt", "&é;", "&#65", "",
]


def wanted(text):
    # A no-break space by its name is a space here.
    return html.unescape(text.replace("&nbsp;", " "))


def test_every_name_and_number(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = {r["k"]: r["d"] for r in rows.select("k", decode_entities(F.col("t")).alias("d")).collect()}
    wrong = [(t, got[k], wanted(t)) for k, t in enumerate(TEXTS) if got[k] != wanted(t)]
    assert not wrong, wrong[:5]


def test_sql_name(spark):
    register_all(spark)
    text = "&copy; &#8364;&euro; a&frac12b &CounterClockwiseContourIntegral; &amp;lt; &bogus;"
    spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("references")
    assert spark.sql("SELECT glean_strip_html(t) AS s FROM references").first()["s"] == html.unescape(text)


@pytest.mark.parametrize("title", ["A &mdash; B", "x&hellip;", "&#x1F600; day"])
def test_titles(spark, title):
    from gleanery.operators.extract import extract_html

    page = spark.createDataFrame([(1, f"<h1>{title}</h1>")], "page_id int, html string")
    assert extract_html(page, {"title": "h1"}).first()["title"] == html.unescape(title)
