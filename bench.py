"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2; the fastest run of each query counts).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlume.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "clean_review_table",
    "collect_app_store",
    "collect_google_play",
    "app_store_parse",
    "google_play_parse",
    "page_walk",
    "batch_walk",
    "dedup_first_seen",
    "lexicon_score",
    "analyze_reviews",
    "sorted_output",
    "union_platforms",
    "csv_roundtrip",
    "run_summary",
    "recency_filter",
    "stream_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("revlume-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="revlume-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    # Landed tables come in many files; the given ones are single row groups, which no task can share.
    landed = tempfile.mkdtemp(prefix="revlume-bench-in-")
    for name in sorted(os.listdir(sf_dir)):
        table = spark.read.parquet(f"{sf_dir}/{name}")
        table.repartition(int(cpus)).write.parquet(f"{landed}/{name}")
    given, sf_dir = sf_dir, landed

    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    reviews = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
                "raw_reviews": reviews,
                "reviews_per_sec_end_to_end": round(reviews / seconds["clean_review_table"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
