"""What the text operators share: their input columns and tables written on the way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no further column of the input can clash."""
    return docs.select(*[docs[f"`{n}`"] for n in names])


def stash(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the folder all executors share and read it back.

    Cuts the lineage: what follows survives a lost executor without the work before it,
    and rows derived from it are the same in every retry.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tillwork-llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def stash_buckets(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """``stash``, dealt by ``key`` into a bucketed table: grouping by it later needs no shuffle of these rows."""
    spark = df.sparkSession
    name = f"tillwork_{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tillwork-llm/{spark.sparkContext.applicationId}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def fraction_of(column: str, salt: int = 0):
    """A stable number in [0, 1) for each value of a column."""
    return (F.xxhash64(F.lit(salt), F.col(column)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
