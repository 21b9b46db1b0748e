"""Time the stages and headline queries on local Spark; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillwork.plans.queries import registry  # noqa: E402
from tillwork.plans.stages import stages  # noqa: E402
from tillwork.session import local_session  # noqa: E402

HEADLINE = (
    "overlap_report", "raw_profile", "annulled_sales", "cleaning_ledger", "code_audit", "sales_headline",
    "clean_profile", "product_dim", "describe_lines", "describe_invoices", "describe_customers",
    "top_products_by_revenue", "products_for_share", "product_running_share", "monthly_sales", "yoy_by_month",
    "invoices_by_weekday", "customer_summary", "pareto_top_share", "country_sales", "log_histogram",
    "top_product_trend", "weekday_hour_counts", "customer_features", "class_profile", "rule_segment_profile",
    "seasonal_naive_metrics",
)
MODELS = ("classifier_metrics", "segment_compare", "forecast_metrics")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the JVM outside the timings
    tables, queries, seconds = stages(spark, sf_dir), registry(), {}

    def timed(name, fn):
        start = time.perf_counter()
        fn()
        seconds[name] = round(time.perf_counter() - start, 3)

    for stage in ("parts", "raw", "audited", "clean", "products", "activity", "customers", "daily"):
        timed(f"stage_{stage}", getattr(tables, stage))
    names = HEADLINE + (MODELS if os.environ.get("BENCH_MODELS", "1") == "1" else ())
    for name in names:
        timed(name, lambda n=name: queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "stages_and_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
