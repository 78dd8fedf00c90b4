import os
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gleanery.functions import collections as coll
from gleanery.functions import dates, text, urls
from gleanery.functions.sql_names import register_all
from gleanery.session import remove_folder, scratch_dir, session_folder, written


class Conf:
    """A session's settings, which a running session does not let us change."""

    def __init__(self, master="local[4]", **values):
        self.conf = {k.replace("_", "."): v for k, v in values.items()}
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1")


def test_scratch_folder_follows_the_checkpoint_setting():
    first, second = (scratch_dir(Conf(spark_checkpoint_dir="hdfs://shared/"), "x") for _ in range(2))
    assert first.startswith("hdfs://shared/gleanery/app-1/x-") and first != second
    assert scratch_dir(Conf(), "x").startswith("/")


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Conf(master), "x")
    assert scratch_dir(Conf(master, spark_checkpoint_dir="/shared"), "x").startswith("/shared/")


def test_scratch_can_be_removed(spark):
    table = written(spark.range(3), "gone")
    folder = session_folder(spark).removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(folder)
    remove_folder(spark, f"{folder}/gone-none")
    assert os.path.isdir(folder)


def test_written_table_is_the_frame(spark):
    frame = spark.range(10).withColumn("text", F.col("id").cast("string"))
    table = written(frame, "test")
    assert table.dtypes == frame.dtypes and sorted(table.collect()) == sorted(frame.collect())
    assert "Range" not in table._jdf.queryExecution().executedPlan().toString()


def test_sql_names_agree_with_the_column_functions(spark):
    register_all(spark)
    rows = spark.createDataFrame(
        [
            ("Tue, 02 Jan 2024 03:04:05 GMT", "http://h/${page}?d=${date}", {"User-Agent": "me"}),
            (" 2024-01-02 \n", "h?z=1&page=2&b=ü#f", None),
            ("a &amp;lt; <b>b</b>　", "plain", {}),
            (None, None, {"ACCEPT": "x"}),
        ],
        "t string, u string, h map<string,string>",
    )
    rows.createOrReplaceTempView("glean_test_rows")
    got = spark.sql(
        "SELECT glean_trim(t) a, glean_strip_html(t) b, glean_parse_date(t) c, "
        "glean_default_timestamp(glean_parse_date(t), TIMESTAMP '2024-05-06 00:00:00') d, "
        "glean_url_template(u, DATE '2024-05-06') e, glean_headers(h) f, glean_truncate(t, 4) g, "
        "glean_default_type(t) h, glean_is_result_type(t) i, glean_set_parameter(u, 'page', '7') j "
        "FROM glean_test_rows"
    ).collect()
    t, u, run_ts = F.col("t"), F.col("u"), F.lit(datetime(2024, 5, 6))
    want = rows.select(
        text.trim_text(t).alias("a"),
        text.strip_html(t).alias("b"),
        dates.parse_date(t).alias("c"),
        dates.default_timestamp(dates.parse_date(t), run_ts).alias("d"),
        urls.render_url_template(u, F.lit(date(2024, 5, 6))).alias("e"),
        coll.effective_headers(F.col("h")).alias("f"),
        text.truncate_text(t, 4).alias("g"),
        coll.default_type(t).alias("h"),
        coll.is_result_type(t).alias("i"),
        urls.set_query_parameter(u, F.lit("page"), F.lit("7")).alias("j"),
    ).collect()
    assert got == want
    assert got[1].j == "h?b=%C3%BC&page=7&z=1#f"
