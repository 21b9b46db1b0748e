"""Reading a table delivered as several named parts, and joining the parts into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.params import BUSINESS_COLUMNS, EXPORT_NAMES, RAW_SCHEMA


def _reader(spark: SparkSession, schema: T.StructType, fmt: str):
    reader = spark.read.schema(schema).format(fmt)
    return reader.option("header", "true") if fmt == "csv" else reader


def read_parts(spark: SparkSession, parts: dict[str, str], schema: T.StructType = RAW_SCHEMA,
               fmt: str = "parquet") -> dict[str, DataFrame]:
    """One lazy scan per part. The schema is given, never inferred, so that ids stay text."""
    return {name: _reader(spark, schema, fmt).load(path) for name, path in parts.items()}


def with_types(df: DataFrame) -> DataFrame:
    """Rename exported headers and cast to the raw schema (nullable integer customer)."""
    df = df.withColumnsRenamed({k: v for k, v in EXPORT_NAMES.items() if k in df.columns})
    ts = {"invoice_ts": F.col("invoice_ts").cast("timestamp_ntz")}
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA if f.name != "invoice_ts"}
    return df.withColumns({**casts, **ts})


def with_file_order(df: DataFrame, name: str = "rid") -> DataFrame:
    """Position of each Parquet row in its file, files in order of their whole path.

    Files are numbered from a table of one row per file, which is broadcast: a shuffle by file would
    send all rows of a file through one task.
    """
    path = F.col("_metadata.file_path")
    numbers = df.select(path.alias("_file")).distinct().select(
        "_file", (F.row_number().over(W.orderBy("_file")) - 1).cast("bigint").alias("_file_no"))
    return (
        df.select("*", F.col("_metadata.row_index").alias("_row"), path.alias("_file"))
        .join(F.broadcast(numbers), "_file")
        .withColumn(name, F.shiftleft("_file_no", 40) + F.col("_row"))
        .drop("_file", "_file_no", "_row")
    )


def tag_parts(parts: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def part_profile(parts: dict[str, DataFrame], ts: str = "invoice_ts") -> DataFrame:
    """Rows, time range and column list of every part, in one pass."""
    columns = F.create_map(*[
        x for name, df in parts.items()
        for x in (F.lit(name), F.lit(", ".join(c for c in df.columns if c != "rid")))])
    return (
        tag_parts(parts).groupBy("part")
        .agg(F.count("*").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .withColumn("columns", columns[F.col("part")])
    )


def _common_range(first: DataFrame, second: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both parts between the start of the second and the end of the first; rows without a time are in neither."""
    start = second.agg(F.min(ts)).scalar()
    end = first.agg(F.max(ts)).scalar()
    return first.where(F.col(ts) >= start), second.where(F.col(ts) <= end)


def overlap_report(first: DataFrame, second: DataFrame, ts: str = "invoice_ts",
                   columns: tuple[str, ...] = BUSINESS_COLUMNS) -> DataFrame:
    """Compare the time range both parts cover, row by row, nulls equal to nulls.

    Both sides are counted per distinct row in one grouped pass, so identical copies
    collapse before the shuffle and no join is needed. ``identical_rows`` counts rows of
    the first part that exist in the second; ``only_*`` are the multiset differences;
    ``range_start`` and ``range_end`` the first and last instant both parts cover.
    """
    left, right = _common_range(first, second, ts)
    counted = (
        left.select(*columns, F.lit(1).alias("_one"), F.lit(0).alias("_two"))
        .unionByName(right.select(*columns, F.lit(0).alias("_one"), F.lit(1).alias("_two")))
        .groupBy(*columns)
        .agg(F.sum("_one").alias("n1"), F.sum("_two").alias("n2"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counted.agg(
        total(F.col("n1")).alias("rows_first"),
        total(F.col("n2")).alias("rows_second"),
        total(F.when(F.col("n2") > 0, F.col("n1"))).alias("identical_rows"),
        total(F.greatest(F.col("n1") - F.col("n2"), F.lit(0))).alias("only_first"),
        total(F.greatest(F.col("n2") - F.col("n1"), F.lit(0))).alias("only_second"),
        F.min(ts).alias("range_start"), F.max(ts).alias("range_end"),
    )


def assert_overlap_identical(first: DataFrame, second: DataFrame,
                             ts: str = "invoice_ts") -> None:
    """Stop the load unless the shared range is the same multiset of rows in both parts."""
    row = overlap_report(first, second, ts).first()
    if row.only_first or row.only_second:
        raise ValueError(
            f"the parts differ in their common range: {row.only_first} rows only in the "
            f"first, {row.only_second} rows only in the second")


def union_parts(first: DataFrame, second: DataFrame, ts: str = "invoice_ts") -> DataFrame:
    """Cut the first part where the second starts, then append the second.

    A row without a time is no part of the overlap and stays; without any time in the second
    part there is no overlap at all.
    """
    start = second.agg(F.min(ts)).scalar()
    return first.where(F.coalesce(F.col(ts) < start, F.lit(True))).unionByName(second)
