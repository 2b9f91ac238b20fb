"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run whole into the ``noop`` sink: one unmeasured run, then the median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from rowkeel.plans.queries import registered

HEADLINES = (
    "fk_audit_all",
    "fk_orphans_one",
    "unique_violations",
    "reconcile_rows",
    "conform_bad_reasons",
    "content_checksum",
    "backfill_null",
    "cascade_delete_counts",
    "header_violations",
    "line_violations",
    "write_once_violations",
    "asof_resolve",
    "set_null_counts",
    "range_overlaps",
    "trigram_pairs",
    "trigram_lookup",
    "knn_exact",
    "knn_cells",
    "copy_roundtrip",
    "restore_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowkeel-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            registered()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or runs == 0:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
