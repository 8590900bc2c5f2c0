"""Seconds per registered query: one warm-up, then the median of the timed runs.

BENCH_RUNS timed runs, three unless told otherwise; a query whose runs have taken BENCH_SECONDS
together, six unless told otherwise, is not run again. The number of runs of each query is
printed with the result. Prints one JSON line.
BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES
(comma-separated names) change what is measured.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verification.queries import QUERIES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs, most = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_SECONDS", "6"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, timed_runs = {}, {}
    for name in names:
        timed = []
        while len(timed) < 2 or len(timed) <= runs and sum(timed[1:]) < most:  # the first is the warm-up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - start)
        seconds[name], timed_runs[name] = round(statistics.median(timed[1:]), 3), len(timed) - 1
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "timed_runs": timed_runs,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
