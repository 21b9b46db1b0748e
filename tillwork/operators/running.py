"""Running totals and row numbers over a whole ordered table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.session import shared_folder


def running_total(df: DataFrame, value: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Sum of ``value`` over all rows up to and including the row, in the given order.

    A window without partitions would send the table through one task. Instead the rows
    are range-partitioned by the order (which must be unique, so ties spread as well),
    each partition gets the total of the partitions before it, and the window runs per
    partition. The range boundaries come from a sample, so the partitioned rows are
    checkpointed: both uses must see the same boundaries, also after a lost executor.
    """
    spark = df.sparkSession
    shared_folder(spark)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.withColumn("_value", value)
        .repartitionByRange(pieces, *order)
        .withColumn("_piece", F.spark_partition_id())
        .checkpoint()
    )
    # At most one row per piece: this window and the broadcast are bounded by `pieces`.
    before = (
        placed.groupBy("_piece").agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(W.orderBy("_piece").rowsBetween(
            W.unboundedPreceding, W.currentRow)) - F.col("_sum"))
        .select("_piece", "_before")
    )
    inside = W.partitionBy("_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.join(F.broadcast(before), "_piece")
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop("_piece", "_before", "_value")
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Consecutive numbers from 1 in the given order."""
    return running_total(df, F.lit(1).cast("bigint"), order, name)
