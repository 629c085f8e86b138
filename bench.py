"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quarry.plans import registry

#: One or two of each kind of operator; each is written to no sink, so that all rows and columns are computed.
QUERIES = (
    "scan_filter_project",
    "aggregate_group_by",
    "join_five_way",
    "window_ranking",
    "text_match_bm25",
    "bayesian_match",
    "knn",
    "fuse_log_odds",
    "path_aggregate_sum",
    "graph_rpq",
    "graph_match",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = registry.queries(), {}
    run = lambda name: found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(QUERIES[0])  # starts the session's threads and compiles the scan
    for name in QUERIES:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "sum of the headline queries' seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
