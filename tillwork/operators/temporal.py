"""Months, commercial years, weekdays and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.functions.columns import commercial_year, month_start, ntz, ratio, sum_money
from tillwork.operators.products import share_of_few

MONTH_ORDER = (12, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)


def complete_axis(df: DataFrame, axis: str, values: list[int], fill: dict | None = None) -> DataFrame:
    """One row for every value of a fixed axis; missing measures stay null or get ``fill``."""
    domain = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in values])).alias(axis))
    full = domain.join(df, axis, "left")
    return full.na.fill(fill) if fill else full


def between_ts(df: DataFrame, low: str | None = None, high: str | None = None,
               ts: str = "invoice_ts") -> DataFrame:
    """Rows with low <= ts < high; both bounds reach the Parquet scan."""
    if low is not None:
        df = df.where(F.col(ts) >= ntz(low))
    if high is not None:
        df = df.where(F.col(ts) < ntz(high))
    return df


def invoice_totals(clean: DataFrame) -> DataFrame:
    return clean.groupBy("invoice").agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("units"),
        sum_money(F.col("revenue")).alias("value"))


def monthly_sales(clean: DataFrame) -> DataFrame:
    ts = F.col("invoice_ts")
    return (
        clean.groupBy(month_start(ts).alias("month"))
        .agg(sum_money(F.col("revenue")).alias("revenue"),
             F.countDistinct("invoice").alias("invoices"),
             F.countDistinct(ts.cast("date")).alias("trading_days"))
        .orderBy("month")
    )


def partial_month(clean: DataFrame, cutoff: str) -> DataFrame:
    """The incomplete month the yearly comparison leaves out, from its own rows only."""
    month = month_start(ntz(cutoff))
    return monthly_sales(
        clean.where((F.col("invoice_ts") >= month.cast("timestamp_ntz"))
                    & (F.col("invoice_ts") < F.add_months(month, 1).cast("timestamp_ntz"))))


def _by_year_and_month(clean: DataFrame, cutoff: str) -> DataFrame:
    ts = F.col("invoice_ts")
    return (
        between_ts(clean, high=cutoff)
        .groupBy(commercial_year(ts).alias("year"), F.month(ts).alias("month"))
        .agg(sum_money(F.col("revenue")).alias("revenue"))
    )


def _of_years(rows: DataFrame, years: tuple[int, ...]) -> DataFrame:
    return rows.where(F.col("year").isin(*years))


def yoy_by_month(clean: DataFrame, years: tuple[int, int], cutoff: str) -> DataFrame:
    """Two commercial years side by side, December first; empty months stay null."""
    y1, y2 = years
    pivoted = _of_years(_by_year_and_month(clean, cutoff), years).groupBy("month").pivot(
        "year", [y1, y2]).agg(F.sum("revenue"))
    table = complete_axis(pivoted, "month", list(MONTH_ORDER))
    first, second = F.col(str(y1)), F.col(str(y2))
    position = F.when(F.col("month") == 12, 0).otherwise(F.col("month"))
    return table.select(
        "month", first.alias("first_year"), second.alias("second_year"),
        ((ratio(second, first) - 1) * 100).alias("change_pct")).orderBy(position)


def yoy_total(yoy: DataFrame) -> DataFrame:
    totals = yoy.agg(F.sum("first_year").alias("first_year"), F.sum("second_year").alias("second_year"))
    return totals.withColumn(
        "change_pct", (ratio(F.col("second_year"), F.col("first_year")) - 1) * 100)


def top_months(clean: DataFrame, years: tuple[int, int], cutoff: str, n: int = 3) -> DataFrame:
    """The n best months of each year and the share of the year they make together."""
    by_year = W.partitionBy("year")  # twelve rows per year
    ranked = (
        _of_years(_by_year_and_month(clean, cutoff), years)
        .withColumn("total", F.sum("revenue").over(by_year))
        .withColumn("position", F.row_number().over(by_year.orderBy(F.desc("revenue"), "month")))
        .where(F.col("position") <= n)
    )
    together = F.sum("revenue").over(by_year)
    return ranked.select(
        "year", "position", "month", "revenue",
        (ratio(together, F.col("total")) * 100).alias("pct_of_year_together")).orderBy("year", "position")


def peak_month(clean: DataFrame, years: tuple[int, int], cutoff: str) -> DataFrame:
    return (
        _of_years(_by_year_and_month(clean, cutoff), years).groupBy("year")
        .agg(F.max_by("month", F.struct("revenue", -F.col("month"))).alias("month"),
             F.max("revenue").alias("revenue"))
        .orderBy("year")
    )


def one_per_invoice(sales: DataFrame) -> DataFrame:
    """Every invoice with the time of its first line in file order."""
    return sales.groupBy("invoice").agg(F.min_by("invoice_ts", "rid").alias("invoice_ts"))


def _weekday(ts: Column) -> Column:
    return F.weekday(ts)  # Monday is 0


def invoices_by_weekday(clean: DataFrame) -> DataFrame:
    counts = one_per_invoice(clean).groupBy(_weekday(F.col("invoice_ts")).alias("weekday")).agg(
        F.count("*").alias("invoices"))
    full = complete_axis(counts, "weekday", list(range(7)), {"invoices": 0})
    return share_of_few(full, "invoices", "pct").orderBy("weekday")


def invoices_by_hour(clean: DataFrame) -> DataFrame:
    counts = one_per_invoice(clean).groupBy(F.hour("invoice_ts").alias("hour")).agg(
        F.count("*").alias("invoices"))
    return share_of_few(counts, "invoices", "pct").orderBy("hour")


def weekday_hour_counts(clean: DataFrame) -> DataFrame:
    """Invoices per weekday and hour, all weekdays for every observed hour."""
    counts = one_per_invoice(clean).groupBy(
        _weekday(F.col("invoice_ts")).alias("weekday"), F.hour("invoice_ts").alias("hour")).agg(
        F.count("*").alias("invoices"))
    grid = counts.select("hour").distinct().withColumn(
        "weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return grid.join(counts, ["weekday", "hour"], "left").na.fill({"invoices": 0}).orderBy(
        "weekday", "hour")


def weekday_hour_matrix(counts: DataFrame, hours: list[int] | None = None) -> DataFrame:
    """The counts as a table with one column per hour of the day."""
    return counts.groupBy("weekday").pivot("hour", hours or list(range(24))).agg(
        F.sum("invoices")).na.fill(0).orderBy("weekday")
