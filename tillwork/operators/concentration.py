"""Concentration of a total over ranked items: Pareto shares and running shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.functions.columns import from_units, money_units, ratio
from tillwork.operators.quantiles import PARTS, order_bucket
from tillwork.operators.running import running_total


def running_share(items: DataFrame, value: str, key: str) -> DataFrame:
    """Every item with the share of the total that it and all larger items hold."""
    total = items.agg(F.sum(money_units(F.col(value)))).scalar()
    ordered = running_total(
        items.select(key, value), money_units(F.col(value)), [F.desc(value), F.col(key)], "_so_far")
    return ordered.select(
        key, value, from_units(F.col("_so_far")).alias("running_total"),
        ratio(F.col("_so_far"), total).alias("running_share"))


def _ranked_values(items: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct amounts with counts, and per bucket what lies above it (largest first).

    The bucket table has a fixed maximum size (see quantiles), so its window may run in
    one task; the items themselves never do.
    """
    amounts = (
        items.select(money_units(F.col(value)).alias("amount"))
        .groupBy("amount").agg(F.count("*").alias("n"))
        .withColumn("bucket", order_bucket(F.col("amount")))
    )
    down = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    buckets = (
        amounts.groupBy("bucket")
        .agg(F.sum("n").alias("bn"), F.sum(F.col("n") * F.col("amount")).alias("bsum"))
        .withColumn("n_until", F.sum("bn").over(down))
        .withColumn("sum_until", F.sum("bsum").over(down))
        .withColumn("items", F.sum("bn").over(everything))
        .withColumn("total", F.sum("bsum").over(everything))
        .withColumn("n_above", F.col("n_until") - F.col("bn"))
        .withColumn("sum_above", F.col("sum_until") - F.col("bsum"))
    )
    return amounts, buckets


def _totalled(rows: DataFrame, label: str, order: str, n: str, amount: str) -> DataFrame:
    """What lies above each row and above or in it, largest first: n_before, n_to, sum_before, sum_to."""
    down = W.partitionBy(label).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("n_to", F.col("n_above") + F.sum(n).over(down))
        .withColumn("sum_to", F.col("sum_above") + F.sum(amount).over(down))
        .withColumn("n_before", F.col("n_to") - F.col(n))
        .withColumn("sum_before", F.col("sum_to") - F.col(amount))
    )


def _crowd(amounts: DataFrame, hits: DataFrame, label: str, aim: str, holds: Column) -> DataFrame:
    """Distinct amounts of that part of each hit bucket which ``holds`` the aim, with what lies above the part.

    The bucket is cut into equal parts of its own range, whose counts and sums are added up before any
    window, so a bucket may hold any number of amounts.
    """
    found = amounts.join(hits.withColumnRenamed("bucket", "_hit"), F.col("bucket").eqNullSafe(F.col("_hit")))
    edges = found.groupBy(F.col(label).alias("_edge")).agg(F.min("amount").alias("_lo"), F.max("amount").alias("_hi"))
    share = F.try_divide((F.col("amount") - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double"))
    placed = found.join(edges, F.col(label).eqNullSafe(F.col("_edge"))).withColumn(
        "_part", F.floor(F.coalesce(share, F.lit(0.0)) * PARTS)).drop("_edge", "_lo", "_hi")
    parts = placed.groupBy(label, "_part").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("amount")).alias("_sum"),
        *[F.first(c).alias(c) for c in ("n_above", "sum_above", aim)])
    hit = _totalled(parts, label, "_part", "_n", "_sum").where(holds).select(
        F.col(label).alias("_of"), F.col("_part").alias("_in"), F.col("n_before").alias("n_above"),
        F.col("sum_before").alias("sum_above"))
    same = F.col(label).eqNullSafe(F.col("_of")) & F.col("_part").eqNullSafe(F.col("_in"))
    return placed.drop("n_above", "sum_above").join(hit, same)


def _inside(amounts: DataFrame, hits: DataFrame, label: str, aim: str, holds: Column) -> DataFrame:
    """The distinct amount of each hit bucket that ``holds`` the aim, with what lies above it."""
    crowd = _crowd(amounts, hits, label, aim, holds).withColumn("_sum", F.col("n") * F.col("amount"))
    return _totalled(crowd, label, "amount", "n", "_sum").where(holds)


def pareto_top_share(items: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """Share of the total held by the top p of the items, k = max(1, half-even(p * n))."""
    amounts, buckets = _ranked_values(items, value)
    k = lambda p: F.greatest(F.lit(1), F.bround(F.col("items") * F.lit(p)).cast("bigint"))
    asked = F.array(*[F.struct(F.lit(p).alias("top"), k(p).alias("k")) for p in shares])
    hits = (
        buckets.withColumn("_a", F.explode(asked)).select("*", "_a.*")
        .where((F.col("k") > F.col("n_above")) & (F.col("k") <= F.col("n_until")))
    )
    holds = (F.col("k") > F.col("n_before")) & (F.col("k") <= F.col("n_to"))
    return (
        _inside(amounts, hits, "top", "k", holds)
        .select("top", F.col("k").alias("customers"),
                ratio(F.col("sum_before") + (F.col("k") - F.col("n_before")) * F.col("amount"),
                      F.col("total")).alias("revenue_share"))
        .orderBy("top")
    )


def items_for_share(items: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """How many of the largest items reach a share: those with running share <= t, plus one.

    Amounts must be positive (clean sales are), so that the running share only grows.
    Items of equal amount are counted in closed form, not one by one.
    """
    amounts, buckets = _ranked_values(items, value)
    asked = F.array(*[F.struct(F.lit(t).alias("share"), (F.col("total") * F.lit(t)).alias("goal"))
                      for t in shares])
    hits = (
        buckets.withColumn("_a", F.explode(asked)).select("*", "_a.*")
        .where((F.col("sum_above") <= F.col("goal")) & (F.col("sum_until") > F.col("goal")))
    )
    fitting = F.floor(F.try_divide(F.col("goal") - F.col("sum_before"), F.col("amount")))
    holds = (F.col("sum_before") <= F.col("goal")) & (F.col("sum_to") > F.col("goal"))
    return (
        _inside(amounts, hits, "share", "goal", holds)
        .withColumn("products", (F.col("n_before") + fitting + 1).cast("bigint"))
        .select("share", "products",
                (ratio(F.col("products"), F.col("items")) * 100).alias("pct_of_catalogue"))
        .orderBy("share")
    )
