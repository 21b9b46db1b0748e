"""Writing tables and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tillwork.session import shuffles_released


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                cluster_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table, one directory per value of ``partition_by``.

    Every task writes what it holds, sorted, so no row is moved for the write; a task leaves one
    file per directory at most, and AQE keeps tasks near its advisory size. Sorted rows let the
    statistics of the pages rule out most of a file for a range of ``cluster_by``.
    """
    if partition_by or cluster_by:
        df = df.sortWithinPartitions(*partition_by, *cluster_by)
    with shuffles_released(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "json") -> None:
    """Write every table of a report under its own name."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
