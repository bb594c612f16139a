"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then three times; the median counts. The result
is written to Spark's ``noop`` sink, so every row is computed and none collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from reefline.catalogue import REGISTRY
from reefline.session import local_session

HEADLINES = [
    "maxn_by_video",
    "maxn_by_chapter",
    "maxn_wide",
    "maxn_moment_boxes",
    "video_metrics",
    "station_metrics",
    "true_positive_detections",
    "best_detections",
    "middle_detections",
    "species_predictions",
    "species_of_a_long_list",
    "suggestion_accuracy",
    "review_stats",
    "stable_periods",
    "combined_metadata",
    "nearby_bathymetry",
    "frame_manifest",
    "diverse_sample",
    "stratified_split",
    "near_duplicate_boxes",
    "motion_scores",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session(cores)
    seconds: dict[str, float] = {}
    for name in wanted:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of three, warm)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
