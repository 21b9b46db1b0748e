"""Customer totals, features, the premium label, and countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.columns import from_units, money_units, ratio, sum_money, whole_days
from tillwork.operators.products import share_of_few
from tillwork.operators.quantiles import exact_quantiles, medians
from tillwork.params import LABEL_QUANTILE, PREDICTORS


def known_customers(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("customer_id").isNotNull())


def customer_summary(clean: DataFrame, activity: DataFrame) -> DataFrame:
    everything = clean.agg(sum_money(F.col("revenue"))).scalar()
    return activity.agg(
        F.count("*").alias("customers"),
        (ratio(from_units(F.sum(money_units(F.col("revenue")))), everything) * 100).alias("pct_revenue_identified"),
        (F.avg((F.col("frequency") == 1).cast("int")) * 100).alias("pct_one_invoice"))


def country_sales(clean: DataFrame) -> DataFrame:
    table = clean.groupBy("country").agg(
        F.count("*").alias("lines"), F.countDistinct("customer_id").alias("customers"),
        sum_money(F.col("revenue")).alias("revenue"))
    return share_of_few(table, "revenue", "pct_revenue")


def top_countries(clean: DataFrame, n: int = 10) -> DataFrame:
    return country_sales(clean).orderBy(F.desc("revenue"), "country").limit(n)


def customer_activity(clean: DataFrame) -> DataFrame:
    """One row per known customer: sums, extremes and distinct counts of the lines.

    All of them combine on the map side, so one customer may hold any share of the lines.
    """
    return known_customers(clean).groupBy("customer_id").agg(
        sum_money(F.col("revenue")).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.countDistinct("invoice").alias("frequency"),
        F.count("*").alias("lines"),
        F.min("invoice_ts").alias("first_ts"),
        F.max("invoice_ts").alias("last_ts"),
        F.countDistinct("stock_code").alias("distinct_products"),
        F.min_by("country", F.when(F.col("country").isNotNull(), F.col("rid"))).alias("country"))


def customer_features(activity: DataFrame, home_country: str) -> DataFrame:
    """Recency and tenure in whole elapsed days up to midnight after the last sale, lines
    per invoice, and the home-country flag."""
    reference = activity.agg(
        F.date_add(F.max("last_ts").cast("date"), 1).cast("timestamp_ntz")).scalar()
    return activity.withColumns({
        "recency": whole_days(F.col("last_ts"), reference),
        "tenure": whole_days(F.col("first_ts"), reference),
        "lines_per_invoice": ratio(F.col("lines"), F.col("frequency")),
        "is_home": F.coalesce(F.col("country") == home_country, F.lit(False)).cast("int")})


def revenue_threshold(customers: DataFrame, q: float = LABEL_QUANTILE) -> DataFrame:
    """One row, one column: the label threshold over all customers."""
    return exact_quantiles(customers, ["revenue"], [q]).select(F.col("value").alias("threshold"))


def with_premium_label(customers: DataFrame, q: float = LABEL_QUANTILE) -> DataFrame:
    threshold = revenue_threshold(customers, q).scalar()
    return customers.withColumn("premium", (F.col("revenue") >= threshold).cast("int"))


def label_summary(customers: DataFrame) -> DataFrame:
    premium = F.col("premium") == 1
    return customers.agg(
        F.count("*").alias("customers"),
        F.sum("premium").cast("bigint").alias("premium_customers"),
        (F.avg("premium") * 100).alias("pct_premium"),
        (ratio(F.sum(F.when(premium, F.col("revenue"))), F.sum("revenue")) * 100).alias("pct_revenue"),
        F.count_if(premium & (F.col("frequency") == 1)).alias("premium_one_invoice"))


def class_profile(customers: DataFrame) -> DataFrame:
    """Median of revenue and of every predictor per class."""
    table = medians(customers, ["revenue", *PREDICTORS], by=["premium"])
    return table.withColumn(
        "class", F.when(F.col("premium") == 1, "Premium").otherwise("Normal")).orderBy("premium")
