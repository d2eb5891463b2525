"""Times the headline queries and prints one JSON line.

Each query is built and run whole into a no-op sink: once to warm up, then
three times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from platewise.plans.queries import REGISTRY  # noqa: E402

HEADLINE = (
    "vendor_daily_orders",
    "product_daily_counts",
    "order_item_menu_join",
    "revenue_rollup",
    "repeat_customers",
    "best_worst_selling",
    "review_comments",
    "sentiment_score",
    "seasonal_forecast",
    "item_level_forecast",
    "forecast_backtest",
    "ration_requirements",
    "sarimax_forecast",
    "split_components",
    "cosine_topk",
    "map_to_root_items",
    "session_turns",
    "vendor_context",
)
RUNS = 3


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("platewise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, directory).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    scale = Path(directory).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
