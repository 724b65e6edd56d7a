"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

The derived tables (changes, scopes, ledgers, claims) are written first, so the
operators alone are timed; a run over the first of them compiles the code.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from changelens.plans import corpus
from changelens.plans.queries import QUERIES

HEADLINE = ["p02_current_file", "x13_surface", "c08_scores", "b00_warnings", "d09_features", "k08_expansions", "g06_ownership", "g10_catch_up", "f02_file_claims", "i04_check_in_delta", "w07_daily"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        corpus.prepare(spark, sf, folder)
        QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
        measure(spark, sf, took)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


def measure(spark: SparkSession, sf: str, took: dict[str, float]) -> None:
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)


if __name__ == "__main__":
    main()
