"""Every operator runs on workers that have no copy of this package."""

import os
import subprocess
import sys

from sample_tables import ROOT, SF

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from gleanery.session import configure
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
configure(spark)

def without(batches):
    try:
        import gleanery
        found = 1
    except ImportError:
        found = 0
    import pandas as pd
    yield pd.DataFrame({{"found": [found]}})

assert spark.range(1, numPartitions=1).mapInPandas(without, "found int").first()["found"] == 0
from gleanery.llm.registry import QUERIES
for name, query in QUERIES.items():
    rows = query(spark, {sf!r}).collect()
    print(name, len(rows), flush=True)
    assert rows, name
"""


def test_queries_on_bare_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, sf=SF)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout[-500:] + done.stderr[-3000:]
    assert done.stdout.count("\n") >= 14
