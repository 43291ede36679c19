"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

import json
import os
import time

from canvass.catalog import QUERIES
from canvass.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ("pivot_mean", "outliers_iqr_multi", "weighted_estimate", "weighted_estimate_multi", "profile_duplicate_rows", "profile_duplicate_columns", "profile_missing_by_column", "chart_histogram", "chart_box_stats", "impute_median", "clean_pipeline")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(4):  # the first is the warm-up
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(sorted(runs[1:])[1], 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
