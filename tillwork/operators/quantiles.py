"""Exact order statistics without gathering a column in one task.

``percentile`` keeps every distinct value of its group in one buffer. Here values are
counted first (copies collapse on the map side), then located through ordered buckets:

1. ``value_counts``: distinct values with their counts, and a bucket number that grows
   with the value. At most ``2 * 1024 * 1025`` buckets exist, whatever the data.
2. A running count over the buckets finds the few buckets that hold a wanted rank.
3. These buckets are cut into equal parts of their own range, and only the part that holds
   the rank is kept.
4. Only the distinct values of those parts are ordered one by one.

Everything is one lazy plan with deterministic expressions: no sampling, no driver
round trip, and a recomputed task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 1024
# A bucket above 1 holds at most 2 ** 42 different doubles, evenly spaced; a part of it at most 2 ** 22.
PARTS = 1 << 20


def order_bucket(value: Column) -> Column:
    """Coarse position of a number: non-decreasing in the value, finer near zero."""
    size = F.floor(F.log2(F.abs(value) + 1) * BUCKETS_PER_DOUBLING)
    return F.when(value < 0, -size).otherwise(size).cast("bigint")


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., column, value, n, bucket) for the non-null values of each column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return (
        df.select(*by, F.explode(pairs).alias("_pair"))
        .select(*by, "_pair.column", "_pair.value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
        .withColumn("bucket", order_bucket(F.col("value")))
    )


def order_statistics(df: DataFrame, cols: Sequence[str],
                     ranks: Mapping[str, Callable[[Column], Column]],
                     by: Sequence[str] = ()) -> DataFrame:
    """Values at given 0-based ranks: rows (by..., column, rank_name, value, total).

    ``ranks`` maps a name to a function from the number of values to the wanted rank.
    A rank outside the group yields no row.
    """
    counts = value_counts(df, cols, by)
    group = [*by, "column"]
    running = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.col("total")
    wanted = F.array(*[
        F.struct(F.lit(name).alias("rank_name"), fn(total).cast("bigint").alias("rank"))
        for name, fn in ranks.items()])
    targets = (
        counts.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
        .withColumn("until", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(W.partitionBy(*group)))
        .withColumn("_want", F.explode(wanted))
        .select(*group, "bucket", "total", "_want.rank_name", "_want.rank",
                (F.col("until") - F.col("n")).alias("start"), "until")
        .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("until")))
        .select(*[F.col(c).alias(f"t_{c}") for c in (*group, "bucket")],
                "rank_name", "total", (F.col("rank") - F.col("start")).alias("inner_rank"))
    )
    # Null-safe on every key: a plain equality would let the optimizer filter nulls on
    # one side only, and the counts would be shuffled once per side instead of once.
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in (*group, "bucket")]
    found = counts.join(targets, same).select(*group, "value", "n", "rank_name", "total", "inner_rank")
    found = _narrowed(found, [*group, "rank_name"])
    inside = W.partitionBy(*group, "rank_name").orderBy("value").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return (
        found.withColumn("_until", F.sum("n").over(inside))
        .where((F.col("inner_rank") < F.col("_until"))
               & (F.col("inner_rank") >= F.col("_until") - F.col("n")))
        .select(*group, "rank_name", "value", "total")
    )


def _narrowed(found: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of the values of each wanted rank's bucket, those of the part that holds the rank.

    The bucket is cut into equal parts of its own range; values are summed per part before
    any window, so a bucket may hold any number of values.
    """
    edges = found.groupBy(*group).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    renamed = edges.select(*[F.col(c).alias(f"e_{c}") for c in group], "_lo", "_hi")
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in group]
    share = F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    placed = found.join(renamed, same).withColumn("_part", F.floor(share * PARTS)).drop(
        *[f"e_{c}" for c in group], "_lo", "_hi")
    running = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = (
        placed.groupBy(*group, "_part").agg(F.sum("n").alias("_n"), F.first("inner_rank").alias("_rank"))
        .withColumn("_until", F.sum("_n").over(running)).withColumn("_start", F.col("_until") - F.col("_n"))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_until")))
        .select(*[F.col(c).alias(f"p_{c}") for c in (*group, "_part")], "_start"))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*group, "_part")]
    return placed.join(parts, same).withColumn("inner_rank", F.col("inner_rank") - F.col("_start")).select(*found.columns)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation: rows (by..., column, prob, value)."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for p in probs:
        ranks[f"{p!r}/lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"{p!r}/hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    found = order_statistics(df, cols, ranks, by)
    parts = F.split("rank_name", "/")
    low = F.max(F.when(F.col("side") == "lo", F.col("value")))
    high = F.max(F.when(F.col("side") == "hi", F.col("value")))
    return (
        found.withColumn("prob", parts[0].cast("double")).withColumn("side", parts[1])
        .groupBy(*by, "column", "prob")
        .agg(low.alias("low"), high.alias("high"), F.max("total").alias("total"))
        .withColumn("position", (F.col("total") - 1) * F.col("prob"))
        .select(*by, "column", "prob",
                (F.col("low") + (F.col("high") - F.col("low"))
                 * (F.col("position") - F.floor("position"))).alias("value"))
    )


def wide_quantiles(df: DataFrame, cols: Sequence[str], names: Mapping[float, str],
                   by: Sequence[str] = ()) -> DataFrame:
    """One row per (by..., column) with one output column per probability."""
    long = exact_quantiles(df, cols, list(names), by)
    return long.groupBy(*by, "column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in names.items()])


def medians(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with the median of every column under its own name."""
    long = exact_quantiles(df, cols, [0.5], by)
    return long.groupBy(*by).agg(*[
        F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])
