import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from gleanery.sinks import writers

ROWS = [
    ("s", 0, ['first, "quoted"\nline', "second"], {"contents": 2, "errors": 0}, []),
    ("t", 0, [" <b>&'x' "], {"contents": 1, "errors": 2}, ["e1", "e2"]),
    ("u", 0, [], {"contents": 0, "errors": 1}, ["e"]),
]
SCHEMA = (
    "source_id string, part bigint, contents array<string>, statistics map<string,bigint>, errors array<string>"
)


@pytest.fixture
def results(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def text_of(path):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_json(spark, results, tmp_path):
    items = spark.createDataFrame(
        [("1", "t", "", [], {}), ("2", "t", "a", ["c"], {"k": "v"})],
        "id string, title string, author string, categories array<string>, metadata map<string,string>",
    )
    writers.write_results(items, f"{tmp_path}/out", "json")
    lines = sorted(text_of(f"{tmp_path}/out").splitlines())
    assert [json.loads(x) for x in lines] == [
        {"id": "1", "title": "t"},
        {"id": "2", "title": "t", "author": "a", "categories": ["c"], "metadata": {"k": "v"}},
    ]


def test_csv(results, tmp_path):
    writers.write_results(results.coalesce(1), f"{tmp_path}/out", "csv")
    rows = list(csv.reader(io.StringIO(text_of(f"{tmp_path}/out"), newline="")))
    assert rows[0] == ["Content", "Error Count"]
    assert sorted(rows[1:]) == sorted([['first, "quoted"\nline', "0"], [" <b>&'x' ", "2"], ["", "1"]])


def test_xml(spark, results, tmp_path):
    writers.write_results(results, f"{tmp_path}/out", "xml")
    schema = "source_id string, contents array<string>, errors array<string>, statistics array<struct<key: string, value: bigint>>"
    back = spark.read.format("xml").schema(schema).option("rowTag", "result").option(
        "ignoreSurroundingSpaces", False
    ).load(f"{tmp_path}/out")
    found = {r.source_id: r for r in back.collect()}
    assert found["t"].contents == [" <b>&'x' "] and found["t"].errors == ["e1", "e2"]
    assert {s.key: s.value for s in found["t"].statistics} == {"contents": 1, "errors": 2}


def test_html_parts_make_one_page(results, tmp_path):
    writers.write_results(results.repartition(3), f"{tmp_path}/out", "html")
    page = text_of(f"{tmp_path}/out")
    assert page.startswith(writers.HTML_HEAD) and page.rstrip().endswith(writers.HTML_TAIL)
    assert "<p> &lt;b&gt;&amp;&#39;x&#39; </p>" in page and "<p></p>" in page
    assert page.count("<p>") == 3


def test_unknown_format(results, tmp_path):
    with pytest.raises(ValueError, match="unsupported format: yaml"):
        writers.write_results(results, str(tmp_path), "yaml")


def test_jdbc_flattens_nested_columns(results, monkeypatch):
    """No database is started here: the call to the JDBC writer is recorded."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen = {}

    def jdbc(self, url, table, mode=None, properties=None):
        kinds = {t for _, t in self._df.dtypes}
        seen.update(url=url, table=table, properties=properties, kinds=kinds)

    monkeypatch.setattr(DataFrameWriter, "jdbc", jdbc)
    writers.write_jdbc(results, "jdbc:x", "t", driver="d")
    assert seen == {
        "url": "jdbc:x", "table": "t", "properties": {"driver": "d"}, "kinds": {"string", "bigint"},
    }


def test_omit_empty_leaves_other_columns(spark):
    frame = spark.range(1).withColumn("tags", F.array().cast("array<string>"))
    assert writers.omit_empty(frame).first().asDict() == {"id": 0, "tags": None}
