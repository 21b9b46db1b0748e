"""Run the whole analysis: ``spark-submit ... -m tillwork PART1 PART2 OUT [--format csv]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tillwork.params import ONLINE_SHOP, TIME_FORMATS, Params
from tillwork.plans.reports import REPORTS, write_reports
from tillwork.plans.stages import from_exports


def main() -> None:
    ap = argparse.ArgumentParser(description="Clean, describe, label, segment and forecast shop sales.")
    ap.add_argument("first", help="older part: file or folder")
    ap.add_argument("second", help="newer part: file or folder")
    ap.add_argument("out", help="shared folder for tables and reports")
    ap.add_argument("--format", default="csv", choices=("csv", "parquet"))
    ap.add_argument("--time-format", nargs="*", default=TIME_FORMATS, help="patterns of the invoice date, tried in turn")
    ap.add_argument("--reports", nargs="*", default=list(REPORTS), choices=list(REPORTS))
    ap.add_argument("--home-country", default=ONLINE_SHOP.home_country)
    ap.add_argument("--years", nargs=2, type=int, default=ONLINE_SHOP.years)
    ap.add_argument("--year-cutoff", default=ONLINE_SHOP.year_cutoff)
    ap.add_argument("--forecast-cut", default=ONLINE_SHOP.forecast_cut)
    a = ap.parse_args()
    spark = SparkSession.builder.appName("tillwork").getOrCreate()
    params = Params(a.home_country, tuple(a.years), a.year_cutoff, a.forecast_cut)
    s = from_exports(spark, {"first": a.first, "second": a.second}, params, a.format, f"{a.out}/tables",
                     tuple(a.time_format))
    write_reports(s, f"{a.out}/reports", a.reports)


if __name__ == "__main__":
    main()
