"""Distribution statistics, table profiles and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.columns import ratio
from tillwork.operators.quantiles import value_counts, wide_quantiles
from tillwork.params import PERCENTILES


def percentile_names(probs: Sequence[float]) -> dict[float, str]:
    return {p: f"p{round(p * 100):02d}" for p in probs}


def sample_skewness(col: str) -> Column:
    """Skewness with the small-sample correction; 0 for a constant, null below 3 values."""
    n, g1 = F.count(col).cast("double"), F.skewness(col)
    corrected = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(F.var_pop(col) == 0, 0.0).otherwise(corrected)


def sample_kurtosis(col: str) -> Column:
    """Excess kurtosis with the small-sample correction; null below 4 values."""
    n, g2 = F.count(col).cast("double"), F.kurtosis(col)
    corrected = ratio((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return F.when(n < 4, None).when(F.var_pop(col) == 0, 0.0).otherwise(corrected)


def skews(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column, skew) from one aggregation."""
    one = df.agg(*[sample_skewness(c).alias(c) for c in cols])
    return _rows(one, [F.struct(F.lit(c).alias("column"), F.col(c).alias("skew")) for c in cols])


def _rows(one: DataFrame, structs: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def describe_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = PERCENTILES,
                     shape: bool = True) -> DataFrame:
    """Count, mean, deviation, extremes, exact percentiles and shape, one row per column."""
    stats = {
        "count": F.count, "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double"),
    }
    if shape:
        stats |= {"skew": sample_skewness, "kurtosis": sample_kurtosis}
    one = df.agg(*[fn(c).alias(f"{c}__{s}") for c in cols for s, fn in stats.items()])
    moments = _rows(one, [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols])
    return moments.join(wide_quantiles(df, cols, percentile_names(probs)), "column", "left")


def table_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, nulls and distinct values of every column, from one aggregation.

    ``exact=False`` counts distinct values with a sketch, which spares the shuffle of
    all distinct values of all columns.
    """
    distinct = F.countDistinct if exact else F.approx_count_distinct
    one = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in df.columns],
        *[distinct(c).alias(f"{c}__distinct") for c in df.columns])
    return _rows(one, [
        F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("type"),
            F.col(f"{name}__nulls").alias("nulls"),
            (ratio(F.col(f"{name}__nulls"), F.col("_rows")) * 100).alias("null_pct"),
            F.col(f"{name}__distinct").alias("distinct_values"))
        for name, kind in df.dtypes])


def table_headline(df: DataFrame, ts: str = "invoice_ts") -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def log_histogram(df: DataFrame, cols: Sequence[str], integer_cols: Sequence[str] = (),
                  edges: int = 50) -> DataFrame:
    """Counts on log-spaced bins between the extremes; all values must be positive.

    Integer columns use whole edges without repeats. Bins are closed on the left, the
    last one on both sides. Values are counted first, so bins are looked up once per
    distinct value.
    """
    counts = value_counts(df, cols)
    step = F.transform(
        F.sequence(F.lit(1), F.lit(edges - 2)),
        lambda i: F.pow(F.lit(10.0), F.log10("lo") + (F.log10("hi") - F.log10("lo")) * i / (edges - 1)))
    spaced = F.concat(F.array("lo"), step, F.array("hi"))
    whole = F.array_distinct(F.transform(spaced, lambda e: F.floor(e).cast("double")))
    limits = (
        counts.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .withColumn("edges", F.when(F.col("column").isin(*integer_cols), whole).otherwise(spaced)
                    if integer_cols else spaced)
        .select("column", "edges")
    )
    bins = limits.select(
        "column", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("bin", "lower"),
        "edges").withColumn("upper", F.element_at("edges", F.col("bin") + 2)).drop("edges")
    # One row of edges per column of the table, so the lookup is a broadcast by nature.
    below = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    filled = (
        counts.join(F.broadcast(limits), "column")
        .withColumn("bin", F.least(below, F.size("edges") - 1) - 1)
        .groupBy("column", "bin").agg(F.sum("n").alias("lines"))
    )
    return (
        bins.join(filled, ["column", "bin"], "left")
        .select("column", "bin", "lower", "upper", F.coalesce("lines", F.lit(0)).alias("lines"))
    )
