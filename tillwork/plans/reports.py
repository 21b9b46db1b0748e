"""The reports: each stage of the analysis as a folder of result tables."""

from __future__ import annotations

from collections.abc import Iterable

from tillwork.plans import queries as q
from tillwork.plans.stages import Stages
from tillwork.sources.sinks import write_report

REPORTS = {
    "ingest": (q.part_profile, q.overlap_report, q.raw_headline, q.raw_profile),
    "cleaning": (q.invoice_prefixes, q.code_normalization_audit, q.cleaning_ledger, q.code_audit,
                 q.annulled_summary, q.annulled_top, q.sales_headline),
    "exploration": (
        q.clean_headline, q.clean_profile, q.multi_description_codes, q.describe_lines, q.describe_invoices,
        q.largest_lines, q.top_products_by_units, q.top_products_by_revenue, q.products_in_both_rankings,
        q.products_for_share, q.monthly_sales, q.yoy_by_month, q.yoy_total, q.top_months, q.partial_month,
        q.invoices_by_weekday, q.invoices_by_hour, q.customer_summary, q.describe_customers,
        q.pareto_top_share, q.top_countries),
    "charts": (q.log_histogram, q.flagged_rankings, q.top_product_trend, q.yoy_by_month, q.peak_month,
               q.weekday_hour_matrix),
    "classification": (
        q.describe_customer_features, q.premium_threshold, q.label_summary, q.class_profile, q.split_summary,
        q.logistic_leaderboard, q.tree_leaderboard, q.tuning_gain, q.classifier_metrics,
        q.classifier_confusion, q.feature_importance, q.tree_rules),
    "segmentation": (q.log_skew, q.kmeans_sweep, q.kmeans_profile, q.mean_shift_sweep, q.mean_shift_profile,
                     q.segment_compare, q.segment_crosstab, q.customer_segments),
    "forecast": (q.daily_headline, q.daily_describe, q.temporal_split, q.seasonal_naive, q.forecast_leaderboard,
                 q.forecast_tuning_gain, q.forecast_metrics, q.forecast_monthly, q.forest_importance,
                 q.daily_forecast),
}


def write_reports(s: Stages, folder: str, names: Iterable[str] = REPORTS, fmt: str = "json") -> None:
    """Compute the named reports and write one folder per table below ``folder/<report>``."""
    for name in names:
        write_report({fn.__name__: fn(s) for fn in REPORTS[name]}, f"{folder}/{name}", fmt)
