import sys

import pytest
from pyspark.sql import SparkSession

from sample_tables import ROOT

sys.path.insert(0, ROOT)

from gleanery.session import BUILD_SETTINGS, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("gleanery-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config(map=BUILD_SETTINGS)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate one column over literal values."""

    def evaluate(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
        return row.select(column.alias("result")).first()["result"]

    return evaluate
