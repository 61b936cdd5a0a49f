"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py [--all | name ...]

Every query is run in full, from the parquet files to a sink that reads all
rows and columns. Nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tallyline.plans.queries import all_queries

HEADLINE = (
    "line_totals",
    "key_metric_summary",
    "daily_totals",
    "customer_features",
    "customer_group_channel",
    "rolling_7",
    "product_performance",
    "top_products",
    "monthly_product",
    "season_products",
    "price_elasticity",
    "freight_elasticity",
    "channel_performance",
    "agreement_analysis",
    "renegotiation_candidates",
    "order_summary",
    "consolidation_by_region",
    "overstocked",
    "margin_swings",
    "feature_f_scores",
    "loss_orders",
    "item_drilldown",
    "correlation_matrix",
    "linear_fit",
    "seasonal_decompose",
    "forecast_daily",
    "recommend_freight_price",
    "price_scenarios",
    "scenario_summary",
    "customer_clusters",
    "margin_linear_model",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = all_queries()
    chosen = list(todo) if names == ["--all"] else names or list(HEADLINE)

    def run(name: str) -> float:
        begin = time.perf_counter()
        todo[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("daily_totals")  # start the JVM's compilers and the file listings
    seconds = {}
    for name in chosen:
        seconds[name] = run(name)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
