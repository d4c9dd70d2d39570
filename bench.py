"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = "radius_of_gyration jump_lengths home_location k_radius_of_gyration uncorrelated_entropy visits_per_location uncorrelated_location_entropy od_matrix interest_network filter_greedy segment_observation_gap trajectory_to_od mean_area_volume temporal_contacts gravity_singly cdr_visits".split()


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from trekmill.plans.registry import QUERIES

    took = {}
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
