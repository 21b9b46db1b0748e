"""Standardising columns, and log transforms of skewed ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.operators.describe import skews
from tillwork.params import RFM


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of some columns (a constant column divides by 1)."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> Scaler:
        row = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols
                       for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
        return cls({c: (row[f"{c}__mean"], row[f"{c}__std"] or 1.0) for c in cols})

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({
            f"{prefix}{c}": (F.col(c) - mean) / std for c, (mean, std) in self.stats.items()})


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return Scaler.fit(df, cols).transform(df)


def log_columns(df: DataFrame, cols: Sequence[str] = RFM) -> DataFrame:
    return df.withColumns({f"log_{c}": F.log1p(c) for c in cols})


def log_skew(df: DataFrame, cols: Sequence[str] = RFM) -> DataFrame:
    """Skewness of every column before and after log1p."""
    logged = log_columns(df, cols)
    both = skews(logged, [*cols, *[f"log_{c}" for c in cols]])
    before = both.where(F.col("column").isin(*cols)).withColumnRenamed("skew", "original")
    after = both.select(F.regexp_replace("column", "^log_", "").alias("column"),
                        F.col("skew").alias("log1p"), F.col("column").startswith("log_").alias("_l"))
    return before.join(after.where("_l").drop("_l"), "column")


def rfm_points(customers: DataFrame) -> DataFrame:
    """Customers with ``x``, the standardised log1p of recency, frequency and revenue."""
    logged = log_columns(customers)
    scaled = standardize(logged, [f"log_{c}" for c in RFM])
    return scaled.select(
        "customer_id", *RFM, "premium", F.array(*[f"z_log_{c}" for c in RFM]).alias("x"))
