"""Every result the engine offers, as a function of the stage tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators import (
    bandwidth, classify, clean, concentration, customers, describe, forecast, pairwise, products, scaling,
    segment, temporal,
)
from tillwork.params import (
    BANDWIDTH_QUANTILES, BUSINESS_COLUMNS, EXPORT_NAMES, PARETO_SHARES, PREDICTORS, REVENUE_SHARES, RFM,
)
from tillwork.plans.stages import Stages, delivery, stages
from tillwork.sources import parts
from tillwork.sources.load import reconciliation
from tillwork.sources.test_view import planted_export

CLEAN_COLUMNS = (*BUSINESS_COLUMNS, "revenue")
QUARTILES = (0.25, 0.50, 0.75)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round floating results that two engines compute with different last digits."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _described(df: DataFrame, cols: list[str], probs=None, shape: bool = True) -> DataFrame:
    out = describe.describe_columns(df, cols, *([probs] if probs else []), shape=shape)
    digits = {c: 6 for c in out.columns if c not in ("column", "count", "kurtosis")}
    return rounded(out, **digits, **({"kurtosis": 4} if shape else {}))


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A short driver-side result table, such as a leaderboard."""
    return spark.createDataFrame(pd.DataFrame(rows))


def planted_delivery(s: Stages) -> str:
    """Folder with the parts as CSV, some of whose cells cannot be read."""
    folder = f"{s.folder}/planted"

    def write():
        for name, df in s.parts().items():
            planted_export(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{folder}/{name}")
        return folder

    return s.once("planted", write)


# Ingest ---------------------------------------------------------------------------------

def part_profile(s: Stages) -> DataFrame:
    return parts.part_profile(s.parts())


def overlap_report(s: Stages) -> DataFrame:
    return parts.overlap_report(*s.parts().values())


def load_reconciliation(s: Stages) -> DataFrame:
    """What becomes of every row of a delivery with planted faults, written out as text."""
    folder = planted_delivery(s)
    found = {name: delivery(s, f"planted_{name}", f"{folder}/{name}", i) for i, name in enumerate(s.parts())}
    counts = reconciliation(found)
    quoted = reduce(DataFrame.unionByName, [
        df.groupBy(F.lit(name).alias("part")).agg(
            F.count_if(F.col("description").startswith('SET OF "6", ')).alias("quoted"),
            F.count_distinct("rid").alias("row_ids"), F.sum("quantity").alias("units")) for name, df in found.items()])
    return counts.join(quoted, "part")


def merged_sales(s: Stages) -> DataFrame:
    return parts.union_parts(*s.parts().values()).select(*BUSINESS_COLUMNS)


def typed_export(s: Stages) -> DataFrame:
    """Rename and cast an export whose columns all arrive as text."""
    text = s.raw().select(*[F.col(v).cast("string").alias(k) for k, v in EXPORT_NAMES.items()])
    return parts.with_types(text)


def raw_headline(s: Stages) -> DataFrame:
    return describe.table_headline(s.raw().select(*BUSINESS_COLUMNS))


def raw_profile(s: Stages) -> DataFrame:
    return rounded(describe.table_profile(s.raw().select(*BUSINESS_COLUMNS)), null_pct=6)


# Cleaning -------------------------------------------------------------------------------

def invoice_prefixes(s: Stages) -> DataFrame:
    return clean.invoice_prefixes(s.raw())


def code_normalization_audit(s: Stages) -> DataFrame:
    return clean.code_normalization_audit(s.raw())


def normalized_codes(s: Stages) -> DataFrame:
    return clean.normalize_codes(s.raw()).groupBy("stock_code").agg(F.count("*").alias("lines"))


def exact_duplicates(s: Stages) -> DataFrame:
    kept = clean.drop_exact_duplicates(clean.normalize_codes(s.raw()))
    return kept.where(F.col("copies") > 1).select(*BUSINESS_COLUMNS, "copies")


def annulled_sales(s: Stages) -> DataFrame:
    return s.audited().where("rule = 'annulled_sale'").select(*BUSINESS_COLUMNS)


def audited_sales(s: Stages) -> DataFrame:
    return s.audited().select(*BUSINESS_COLUMNS, "copies", "rule")


def cleaning_ledger(s: Stages) -> DataFrame:
    return rounded(clean.cleaning_ledger(s.audited()), pct_of_input=6)


def code_audit(s: Stages) -> DataFrame:
    return rounded(clean.code_audit(s.audited()), median_price=6)


def annulled_summary(s: Stages) -> DataFrame:
    return clean.annulled_summary(s.audited())


def annulled_top(s: Stages) -> DataFrame:
    return clean.annulled_top(s.audited())


def clean_sales(s: Stages) -> DataFrame:
    return s.clean().select(*CLEAN_COLUMNS)


def sales_headline(s: Stages) -> DataFrame:
    return rounded(clean.sales_headline(s.clean()), pct_without_customer=6)


# Exploration ----------------------------------------------------------------------------

def clean_headline(s: Stages) -> DataFrame:
    return describe.table_headline(s.clean().select(*CLEAN_COLUMNS))


def clean_profile(s: Stages) -> DataFrame:
    named = products.with_product(s.clean().select(*CLEAN_COLUMNS), s.products())
    return rounded(describe.table_profile(named.select(*CLEAN_COLUMNS, "product")), null_pct=6)


def sales_with_product(s: Stages) -> DataFrame:
    named = products.with_product(s.clean(), s.products(), "inner")
    return named.select("invoice", "stock_code", "product", "quantity", "revenue")


def product_dim(s: Stages) -> DataFrame:
    return products.product_dim(s.clean())


def multi_description_codes(s: Stages) -> DataFrame:
    return products.multi_description_codes(s.products())


def describe_lines(s: Stages) -> DataFrame:
    return _described(s.clean(), ["quantity", "price", "revenue"])


def describe_invoices(s: Stages) -> DataFrame:
    return _described(temporal.invoice_totals(s.clean()), ["lines", "units", "value"])


def describe_customers(s: Stages) -> DataFrame:
    return _described(s.activity().withColumnRenamed("frequency", "invoices"), ["invoices", "revenue"])


def invoice_totals(s: Stages) -> DataFrame:
    return temporal.invoice_totals(s.clean())


def largest_lines(s: Stages) -> DataFrame:
    return products.largest_lines(s.clean(), s.products())


def top_products_by_units(s: Stages) -> DataFrame:
    return rounded(products.top_products(s.products(), "units"), pct_units=6)


def top_products_by_revenue(s: Stages) -> DataFrame:
    return rounded(products.top_products(s.products(), "revenue"), pct_revenue=6)


def products_in_both_rankings(s: Stages) -> DataFrame:
    return products.in_both_rankings(s.products())


def products_for_share(s: Stages) -> DataFrame:
    return rounded(concentration.items_for_share(s.products(), "revenue", REVENUE_SHARES), pct_of_catalogue=6)


def product_running_share(s: Stages) -> DataFrame:
    return rounded(concentration.running_share(s.products(), "revenue", "stock_code"), running_share=6)


def monthly_sales(s: Stages) -> DataFrame:
    return temporal.monthly_sales(s.clean())


def _yoy(s: Stages) -> DataFrame:
    return temporal.yoy_by_month(s.clean(), s.params.years, s.params.year_cutoff)


def yoy_by_month(s: Stages) -> DataFrame:
    return rounded(_yoy(s), change_pct=6)


def yoy_total(s: Stages) -> DataFrame:
    return rounded(temporal.yoy_total(_yoy(s)), first_year=4, second_year=4, change_pct=6)


def top_months(s: Stages) -> DataFrame:
    out = temporal.top_months(s.clean(), s.params.years, s.params.year_cutoff)
    return rounded(out, pct_of_year_together=6)


def partial_month(s: Stages) -> DataFrame:
    return temporal.partial_month(s.clean(), s.params.year_cutoff)


def peak_month(s: Stages) -> DataFrame:
    return temporal.peak_month(s.clean(), s.params.years, s.params.year_cutoff)


def one_per_invoice(s: Stages) -> DataFrame:
    """On raw lines, where the lines of one cancellation may carry two times."""
    return temporal.one_per_invoice(s.raw())


def invoices_by_weekday(s: Stages) -> DataFrame:
    return rounded(temporal.invoices_by_weekday(s.clean()), pct=6)


def invoices_by_hour(s: Stages) -> DataFrame:
    return rounded(temporal.invoices_by_hour(s.clean()), pct=6)


def customer_summary(s: Stages) -> DataFrame:
    return rounded(customers.customer_summary(s.clean(), s.activity()), pct_revenue_identified=6, pct_one_invoice=6)


def pareto_top_share(s: Stages) -> DataFrame:
    return rounded(concentration.pareto_top_share(s.activity(), "revenue", PARETO_SHARES), revenue_share=6)


def country_sales(s: Stages) -> DataFrame:
    return rounded(customers.country_sales(s.clean()), pct_revenue=6)


def top_countries(s: Stages) -> DataFrame:
    return rounded(customers.top_countries(s.clean()), pct_revenue=6)


# Tables behind charts -------------------------------------------------------------------

def log_histogram(s: Stages) -> DataFrame:
    out = describe.log_histogram(s.clean(), ["quantity", "price", "revenue"], ["quantity"])
    return rounded(out, lower=6, upper=6)


def flagged_rankings(s: Stages) -> DataFrame:
    return products.flagged_rankings(s.products())


def top_product_trend(s: Stages) -> DataFrame:
    return products.top_product_trend(s.clean(), s.products(), s.params.year_cutoff)


def weekday_hour_counts(s: Stages) -> DataFrame:
    return temporal.weekday_hour_counts(s.clean())


def weekday_hour_matrix(s: Stages) -> DataFrame:
    matrix = temporal.weekday_hour_matrix(temporal.weekday_hour_counts(s.clean()))
    return matrix.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})


# Customers and label --------------------------------------------------------------------

def customer_features(s: Stages) -> DataFrame:
    activity = customers.customer_activity(s.clean())
    labelled = customers.with_premium_label(customers.customer_features(activity, s.params.home_country))
    return rounded(labelled, lines_per_invoice=6)


def describe_customer_features(s: Stages) -> DataFrame:
    return _described(s.customers(), ["revenue", "units", *PREDICTORS], QUARTILES, shape=False)


def premium_threshold(s: Stages) -> DataFrame:
    return rounded(customers.revenue_threshold(s.customers()), threshold=6)


def label_summary(s: Stages) -> DataFrame:
    return rounded(customers.label_summary(s.customers()), pct_premium=6, pct_revenue=6)


def class_profile(s: Stages) -> DataFrame:
    return rounded(customers.class_profile(s.customers()), **{c: 6 for c in ("revenue", *PREDICTORS)})


def split_summary(s: Stages) -> DataFrame:
    split = classify.stratified_split(s.customers().select("customer_id", "premium"))
    return rounded(classify.split_summary(split), pct_premium_test=6, pct_majority=6)


def _by_rule(s: Stages) -> DataFrame:
    """A fixed rule in place of a model, so that the measures have an exact answer."""
    return s.customers().withColumn("prediction", (F.col("frequency") >= 13).cast("int"))


def rule_metrics(s: Stages) -> DataFrame:
    return rounded(classify.classification_metrics(_by_rule(s)), precision=6, recall=6, f1=6)


def rule_confusion(s: Stages) -> DataFrame:
    return classify.confusion_matrix(_by_rule(s))


# Segments on a fixed rule ---------------------------------------------------------------

def _rule_group() -> Column:
    return F.least(F.lit(3), F.floor(F.col("recency") / 100)).cast("int")


def _rule_segments(s: Stages) -> DataFrame:
    return s.customers().withColumn("segment", _rule_group())


def log_skew(s: Stages) -> DataFrame:
    return rounded(scaling.log_skew(s.customers()), original=6, log1p=6)


def standardized_rfm(s: Stages) -> DataFrame:
    points = scaling.rfm_points(s.customers())
    return points.select("customer_id", *[F.round(F.col("x")[i], 6).alias(f"z_{c}") for i, c in enumerate(RFM)])


def rule_segment_profile(s: Stages) -> DataFrame:
    out = segment.segment_profile(_rule_segments(s), "segment")
    return rounded(out, pct_premium=6, pct_customers=6, pct_revenue=6, recency=6, frequency=6, revenue=6)


def rule_segment_relabel(s: Stages) -> DataFrame:
    return segment.relabel_by_median(_rule_segments(s), "segment").select("customer_id", "segment")


def rule_segment_crosstab(s: Stages) -> DataFrame:
    return segment.crosstab(_rule_segments(s), "segment", "premium")


def rule_segment_sizes(s: Stages) -> DataFrame:
    return segment.cluster_sizes(_rule_segments(s), "segment")


def rule_silhouette(s: Stages) -> DataFrame:
    points = scaling.rfm_points(s.customers()).withColumn("label", _rule_group())
    value = pairwise.silhouettes(points, ["label"])["label"]
    return s.spark.range(1).select(F.round(F.lit(value).cast("double"), 6).alias("silhouette"))


def bandwidth_estimates(s: Stages) -> DataFrame:
    found = bandwidth.estimate_bandwidths(scaling.rfm_points(s.customers()), BANDWIDTH_QUANTILES)
    return rounded(_rows(s.spark, [{"quantile": q, "bandwidth": h} for q, h in found.items()]), bandwidth=5)


# Daily series ---------------------------------------------------------------------------

def daily_sales(s: Stages) -> DataFrame:
    return forecast.calendar_features(forecast.drop_last_day(forecast.daily_sales(s.clean())))


def daily_headline(s: Stages) -> DataFrame:
    return forecast.daily_headline(s.daily())


def daily_describe(s: Stages) -> DataFrame:
    return _described(s.daily(), ["revenue"], QUARTILES, shape=False)


def temporal_split(s: Stages) -> DataFrame:
    return forecast.split_headline(s.daily(), s.params.forecast_cut)


def calendar_dummies(s: Stages) -> DataFrame:
    return forecast.dummies(s.daily()).select("day", *forecast.DUMMY_COLUMNS)


def linear_normal_equations(s: Stages) -> DataFrame:
    """Residuals of the least-squares fit summed over each indicator's training days: zero at the solution."""
    train, _ = forecast.temporal_split(s.daily(), s.params.forecast_cut)
    fitted = forecast.predict_linear(forecast.fit_linear(train), train)
    left = forecast.dummies(fitted).withColumn("_left", F.col("revenue") - F.col("prediction")).withColumn("intercept", F.lit(1))
    names = ["intercept", *forecast.DUMMY_COLUMNS]
    sums = left.agg(*[F.sum(F.col(c) * F.col("_left")).alias(c) for c in names])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.abs(F.round(c, 2)).alias("residual_sum")) for c in names])).alias("_r")).select("_r.*")


def seasonal_naive(s: Stages) -> DataFrame:
    return rounded(forecast.seasonal_naive(s.daily(), s.params.forecast_cut), prediction=6)


def seasonal_naive_metrics(s: Stages) -> DataFrame:
    scored = forecast.seasonal_naive(s.daily(), s.params.forecast_cut)
    return rounded(forecast.forecast_metrics(scored), mae=6, rmse=6, r2=6, total_error_pct=6)


def seasonal_naive_monthly(s: Stages) -> DataFrame:
    scored = forecast.seasonal_naive(s.daily(), s.params.forecast_cut)
    return forecast.monthly_forecast(scored, ["revenue", "prediction"])


# Fitted models --------------------------------------------------------------------------

def _study(s: Stages) -> classify.Study:
    return s.once("study", lambda: classify.run_study(s.customers()))


def stratified_split(s: Stages) -> DataFrame:
    return classify.stratified_split(s.customers().select("customer_id", "premium"))


def logistic_leaderboard(s: Stages) -> DataFrame:
    return _rows(s.spark, classify.leaderboard(_study(s).logistic_cv))


def tree_leaderboard(s: Stages) -> DataFrame:
    return _rows(s.spark, classify.leaderboard(_study(s).tree_cv))


def tuning_gain(s: Stages) -> DataFrame:
    return _rows(s.spark, _study(s).compare())


def _both_models(s: Stages, table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    study = _study(s)
    one, two = (table(study.scored(m)).withColumn("model", F.lit(m)) for m in ("logistic", "tree"))
    return one.unionByName(two)


def classifier_metrics(s: Stages) -> DataFrame:
    return _both_models(s, classify.classification_metrics)


def classifier_confusion(s: Stages) -> DataFrame:
    return _both_models(s, classify.confusion_matrix)


def feature_importance(s: Stages) -> DataFrame:
    return _rows(s.spark, _study(s).importance())


def tree_rules(s: Stages) -> DataFrame:
    lines = _study(s).tree.rules().rstrip().split("\n")
    return _rows(s.spark, [{"line": i, "rule": text} for i, text in enumerate(lines)])


def _segmentation(s: Stages) -> segment.Segmentation:
    return s.once("segmentation", lambda: segment.run_segmentation(s.customers()))


def kmeans_sweep(s: Stages) -> DataFrame:
    return _rows(s.spark, _segmentation(s).kmeans_rows)


def mean_shift_sweep(s: Stages) -> DataFrame:
    return _rows(s.spark, _segmentation(s).shift_rows)


def segment_compare(s: Stages) -> DataFrame:
    return _rows(s.spark, _segmentation(s).compare_rows)


def customer_segments(s: Stages) -> DataFrame:
    return s.stage("segments", lambda: _segmentation(s).segments())


def kmeans_profile(s: Stages) -> DataFrame:
    return segment.segment_profile(customer_segments(s), "kmeans")


def mean_shift_profile(s: Stages) -> DataFrame:
    return segment.segment_profile(customer_segments(s), "mean_shift")


def segment_crosstab(s: Stages) -> DataFrame:
    return segment.crosstab(customer_segments(s), "kmeans", "mean_shift")


def _outlook(s: Stages) -> forecast.Outlook:
    return s.once("outlook", lambda: forecast.run_outlook(s.daily(), s.params.forecast_cut))


def daily_forecast(s: Stages) -> DataFrame:
    return _outlook(s).scored


def forecast_metrics(s: Stages) -> DataFrame:
    return _outlook(s).metrics()


def forecast_monthly(s: Stages) -> DataFrame:
    return forecast.monthly_forecast(_outlook(s).scored, ["revenue", "naive", "linear", "forest"])


def forecast_leaderboard(s: Stages) -> DataFrame:
    return _rows(s.spark, _outlook(s).leaderboard())


def forecast_tuning_gain(s: Stages) -> DataFrame:
    return _rows(s.spark, _outlook(s).compare())


def forest_importance(s: Stages) -> DataFrame:
    return _rows(s.spark, _outlook(s).importance())


ALL = (
    part_profile, overlap_report, load_reconciliation, merged_sales, typed_export, raw_headline, raw_profile,
    invoice_prefixes, code_normalization_audit, normalized_codes, exact_duplicates, annulled_sales,
    audited_sales, cleaning_ledger, code_audit, annulled_summary, annulled_top, clean_sales, sales_headline,
    clean_headline, clean_profile, sales_with_product, product_dim, multi_description_codes,
    describe_lines, describe_invoices, describe_customers, invoice_totals, largest_lines,
    top_products_by_units, top_products_by_revenue, products_in_both_rankings, products_for_share,
    product_running_share, monthly_sales, yoy_by_month, yoy_total, top_months, partial_month, peak_month,
    one_per_invoice, invoices_by_weekday, invoices_by_hour, customer_summary, pareto_top_share,
    country_sales, top_countries, log_histogram, flagged_rankings, top_product_trend,
    weekday_hour_counts, weekday_hour_matrix, customer_features, describe_customer_features,
    premium_threshold, label_summary, class_profile, split_summary, rule_metrics, rule_confusion,
    log_skew, standardized_rfm, rule_segment_profile, rule_segment_relabel, rule_segment_crosstab,
    rule_segment_sizes, rule_silhouette, bandwidth_estimates, daily_sales, daily_headline, daily_describe,
    temporal_split, calendar_dummies, linear_normal_equations, seasonal_naive, seasonal_naive_metrics, seasonal_naive_monthly,
    stratified_split, logistic_leaderboard, tree_leaderboard, tuning_gain, classifier_metrics,
    classifier_confusion, feature_importance, tree_rules, kmeans_sweep, mean_shift_sweep, segment_compare,
    customer_segments, kmeans_profile, mean_shift_profile, segment_crosstab, daily_forecast,
    forecast_metrics, forecast_monthly, forecast_leaderboard, forecast_tuning_gain, forest_importance,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: (lambda spark, sf_dir, fn=fn: fn(stages(spark, sf_dir))) for fn in ALL}
