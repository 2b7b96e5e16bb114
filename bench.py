"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from voltlane.queries import QUERIES
from voltlane.session import build_session

HEADLINE = [
    "label_points_by_interval", "merge_intervals", "downsample_time", "interval_coverage", "window_features",
    "sequence_windows", "interval_stats", "regularise_ffill", "seasonal_decompose", "periodogram", "autocorrelation",
    "column_stats", "duration_stats", "sequential_split", "stratified_split", "correlation_matrix", "threshold_all_scores",
    "auroc", "average_precision", "point_adjustment", "mutual_information", "standardise", "fit_random_forest",
    "fit_boosted_trees",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
