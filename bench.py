"""Headline queries, timed: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import queries  # noqa: E402
from tidemark.session import local_session, shared_dir  # noqa: E402

HEADLINE = [
    "reconcile_tables",
    "table_fingerprint",
    "referential_integrity",
    "key_check",
    "row_diff",
    "range_fingerprints",
    "bulk_load",
    "build_catalog",
    "score_risk",
    "load_waves",
    "object_existence",
    "requote_identifiers",
    "retrieve_batch",
    "retrieve_ann",
    "counter_rate_5m",
    "histogram_quantile_5m",
    "status_changes",
    "trace_timeline",
    "stream_increase",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries.load_all()
    spark = local_session("bench", cpus)
    shared_dir(spark)
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            # Every run builds a new plan, so nothing is reused from the one before.
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(x, 2) for x in times], file=sys.stderr, flush=True)
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    result = {
        "metric": "headline queries, median of 3 warm runs, summed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
        "heap": spark.conf.get("spark.driver.memory", "default"),
        "lineitem_rows": lineitem,
    }
    if "bulk_load" in seconds:
        tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
        rows = sum(spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in tables)
        result["load_rows_per_sec"] = round(rows / seconds["bulk_load"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
