"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query is run once to warm up and then timed over
BENCH_REPEATS runs, of which the median counts; every run writes its whole result to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from harborline.session import local_session  # noqa: E402

HEADLINE = (
    "d01_monthly_demand", "t01_top_categories", "d05_seller_metrics", "d03_state_metrics", "e05_equal_thirds",
    "d09_order_values", "b12_item_value_ladder", "b20_anomaly_repair", "b07_delivery_days_ladder",
    "e01_top_category_first", "f05_seasonality", "f15_moving_average", "h06_recommendations", "f10_order_search",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session("bench", cpus, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
