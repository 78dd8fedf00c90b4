"""Time the headline queries; prints one JSON line.

Every query runs over its whole tables and is written to the no-op sink, so all
columns are computed. One warm-up run, then the median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleanery.plans.catalog import QUERIES  # noqa: E402
from gleanery.session import BUILD_SETTINGS  # noqa: E402

HEADLINE = [
    "host_report",
    "extract_html",
    "extract_html_items",
    "extract_json",
    "extract_xml",
    "dispatch_extract",
    "result_items",
    "strip_html",
    "normalize_by_type",
    "parse_date",
    "filter_keywords",
    "paginate",
    "robots_allowed",
    "robots_asof",
    "token_bucket_schedule",
    "retry_schedule",
    "rate_audit",
    "source_stats",
    "aggregate_results",
    "result_rollup",
    "write_json",
    "stream_items",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleanery-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config(map=BUILD_SETTINGS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    for name in QUERIES if wanted == "all" else wanted.split(","):

        def run() -> None:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
