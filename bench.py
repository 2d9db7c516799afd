"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
threads. Every query reads its tables from disk and is forced with a no-op sink; a first
query warms the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import time

from tidebook.plans.queries import QUERIES
from tidebook.session import build_session

HEADLINE = (
    "monthly_metrics", "order_level", "category_month", "category_ranking", "event_spikes", "product_ranking", "top_products_month",
    "business_impact", "category_uplift", "large_by_month", "early_warning_scorecard", "forecast_comparison", "zip3_revenue",
    "seller_customer_distance", "review_clean", "full_outer_base", "payment_quantiles",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidebook-bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="12g", spark__sql__shuffle__partitions=cpus
    )
    spark.sparkContext.setLogLevel("ERROR")

    def force(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].run(spark, directory).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    force("category_daily")
    seconds = {name: force(name) for name in HEADLINE}
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
