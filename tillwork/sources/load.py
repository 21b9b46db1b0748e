"""Loading exported parts whole: every delivered row is loaded, cut as overlap, or rejected with a reason."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.params import BUSINESS_COLUMNS, EXPORT_NAMES, EXPORT_SCHEMA, RAW_SCHEMA, REQUIRED, TIME_FORMATS

BROKEN = "_broken"
PLACE = ("_path", "_block", "_row")


def scan_export(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """The cells as delivered, with the place of each row in the delivery.

    CSV cells stay text; quotes inside quoted cells are doubled; a header that names other
    columns stops the scan. ``multi_line`` lets quoted cells hold line breaks, at the price
    of one task per file.
    """
    if fmt == "csv":
        cells = [T.StructField(f.name, T.StringType()) for f in EXPORT_SCHEMA]
        reader = (spark.read.schema(T.StructType([*cells, T.StructField(BROKEN, T.StringType())]))
                  .option("header", "true").option("escape", '"').option("enforceSchema", "false")
                  .option("columnNameOfCorruptRecord", BROKEN).option("multiLine", str(multi_line).lower()))
    else:
        reader = spark.read.schema(EXPORT_SCHEMA)
    df = reader.format(fmt).load(path)
    if fmt != "csv":
        df = df.withColumn(BROKEN, F.lit(None).cast("string"))
    return df.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))


def whole_number(cell: Column) -> Column:
    """A whole number, also written with a zero fraction (13085.0); null if it is none."""
    text = F.trim(cell)
    return F.when(text.rlike(r"^[+-]?\d+(\.0+)?$"), F.regexp_replace(text, r"\.0+$", "").try_cast("bigint"))


def point_in_time(cell: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """A local time in the first of the formats that fits; null if none does."""
    tries = [F.when(F.try_to_timestamp(cell, F.lit(f)).isNotNull(), F.to_timestamp_ntz(cell, F.lit(f))) for f in formats]
    return F.coalesce(*tries)


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def checked(df: DataFrame, formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """Typed business columns, ``reject_reason`` (null for a good row) and ``delivered``, the row as JSON.

    A row is rejected if the line cannot be cut into cells, if a cell is there but cannot be
    read as its type, or if a required cell is missing.
    """
    old_names = {new: old for old, new in EXPORT_NAMES.items()}
    typed, reasons = {}, [F.when(F.col(BROKEN).isNotNull(), "broken line")]
    for f in RAW_SCHEMA:
        cell = F.col(f"`{old_names[f.name]}`")
        is_text = isinstance(df.schema[old_names[f.name]].dataType, T.StringType)
        if not is_text or isinstance(f.dataType, T.StringType):
            value = cell.cast(f.dataType)
        elif isinstance(f.dataType, T.LongType):
            value = whole_number(cell)
        elif isinstance(f.dataType, T.DoubleType):
            value = _finite(F.trim(cell).try_cast("double"))
        else:
            value = point_in_time(F.trim(cell), formats)
        typed[f.name] = value.alias(f.name)
        if is_text and not isinstance(f.dataType, T.StringType):
            reasons.append(F.when(F.trim(cell).isNotNull() & (F.trim(cell) != "") & value.isNull(), f"unreadable {f.name}"))
            missing = cell.isNull() | (F.trim(cell) == "")
        else:
            missing = cell.isNull()
        if f.name in REQUIRED:
            reasons.append(F.when(missing, f"missing {f.name}"))
    why = F.array_join(F.array_compact(F.array(*reasons)), ", ")
    delivered = F.to_json(F.struct(*[F.col(f"`{c}`") for c in (*EXPORT_NAMES, BROKEN)]))
    return df.select(*typed.values(), F.when(why != "", why).alias("reject_reason"),
                     F.when(why != "", delivered).alias("delivered"), *PLACE)


def with_delivery_ids(written: DataFrame, part_number: int = 0) -> DataFrame:
    """Number the rows of a written scan by path, then by place in the file.

    The scan's tasks may take files and blocks in any order; rows of one block lie together in
    one task. So blocks are ordered by path and start, and rows count on from the rows of
    the blocks before. The part number takes the highest bits.
    """
    blocks = written.groupBy("_path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1))  # a row per block
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    rid = F.col("_before") + F.col("_row") - F.col("_first") + F.lit(part_number << 56).cast("bigint")
    return written.join(blocks, ["_path", "_block"]).withColumn("rid", rid).drop(*PLACE, "_before", "_first")


def good_rows(numbered: DataFrame) -> DataFrame:
    return numbered.where("reject_reason IS NULL").select(*BUSINESS_COLUMNS, "rid")


def reconciliation(parts: dict[str, DataFrame], ts: str = "invoice_ts") -> DataFrame:
    """Per part: rows delivered, rejected, cut as overlap, and loaded. The oldest part comes first.

    ``parts``: all numbered rows of each part, with their ``reject_reason``.
    """
    first, *_, last = parts
    start = good_rows(parts[last]).agg(F.min(ts)).scalar()
    tagged = reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("part"), ts, "reject_reason", (F.col(ts) >= start).alias("_late"))
        for name, df in parts.items()])
    good = F.col("reject_reason").isNull()
    cut = good & (F.col("part") == first) & F.col("_late")
    return tagged.groupBy("part").agg(
        F.count("*").alias("delivered"), F.count_if(~good).alias("rejected"), F.count_if(cut).alias("overlap"),
        F.count_if(good & ~F.coalesce(cut, F.lit(False))).alias("loaded"))


def assert_nothing_lost(first: DataFrame, second: DataFrame, raw: DataFrame, ts: str = "invoice_ts") -> None:
    """Stop unless the joined table has every row of both parts but those cut as overlap."""
    start = second.agg(F.min(ts)).scalar()
    old, new = first.agg(F.count("*").alias("n"), F.count_if(F.col(ts) >= start).alias("cut")).first(), second.count()
    if (loaded := raw.count()) != old.n - old.cut + new:
        raise ValueError(f"{old.n} and {new} rows came, {old.cut} are overlap, but {loaded} would be loaded")


