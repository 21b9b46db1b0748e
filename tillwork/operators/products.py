"""Product dimension, rankings and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.functions.columns import from_units, money_units, month_start, ntz, ratio, sum_money


def product_dim(clean: DataFrame) -> DataFrame:
    """One row per code, named by its most frequent description (ties: smallest text).

    Lines are first reduced to (code, description), so a best seller with a third of all
    lines arrives at its group as a handful of rows.
    """
    spelled = clean.groupBy("stock_code", "description").agg(
        F.count("*").alias("n"), F.sum("quantity").alias("units"),
        F.sum(money_units(F.col("revenue"))).alias("amount"))
    rank = F.when(F.col("description").isNotNull(), F.struct(-F.col("n"), F.col("description")))
    return spelled.groupBy("stock_code").agg(
        F.min_by("description", rank).alias("product"),
        F.count("description").alias("descriptions"),
        F.sum("n").alias("lines"), F.sum("units").alias("units"),
        from_units(F.sum("amount")).alias("revenue"))


def multi_description_codes(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count_if(F.col("descriptions") > 1).alias("codes_with_several"),
        F.count("*").alias("codes"))


def with_product(sales: DataFrame, products: DataFrame, how: str = "left") -> DataFrame:
    """Attach the product name.

    No broadcast hint: the catalogue grows with the data, so Spark decides by its
    measured size, and AQE splits the partitions of best sellers in the other case.
    """
    return sales.join(products.select("stock_code", "product"), "stock_code", how)


def top_n(df: DataFrame, col: str, n: int, tie_key: str) -> DataFrame:
    """The n largest rows; each task keeps n, nothing is sorted as a whole."""
    return df.orderBy(F.desc(col), F.asc(tie_key)).limit(n)


def largest_lines(clean: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The lines with the largest quantity; names are attached to these n rows only."""
    return with_product(top_n(clean, "quantity", n, "rid"), products).select(
        "invoice", "stock_code", "product", "quantity", "price", "customer_id", "country")


def with_share(df: DataFrame, col: str, name: str, of: DataFrame | None = None) -> DataFrame:
    """Percentage of the column's total, over ``of`` or over the table itself."""
    whole = (df if of is None else of).agg(F.sum(col)).scalar()
    return df.withColumn(name, ratio(F.col(col), whole) * 100)


def share_of_few(df: DataFrame, col: str, name: str) -> DataFrame:
    """The same for a table that is short by nature (weekdays, hours, countries).

    The total comes from a window over those few rows, which spares a second pass over
    the lines they were counted from.
    """
    return df.withColumn(name, ratio(F.col(col), F.sum(col).over(W.partitionBy())) * 100)


def top_products(products: DataFrame, col: str, n: int = 10) -> DataFrame:
    top = top_n(products, col, n, "stock_code").select("stock_code", "product", "units", "revenue")
    return with_share(top, col, f"pct_{col}", of=products).orderBy(F.desc(col), "stock_code")


def in_both_rankings(products: DataFrame, n: int = 10) -> DataFrame:
    a = top_n(products, "units", n, "stock_code").select("stock_code")
    b = top_n(products, "revenue", n, "stock_code").select("stock_code")
    return a.intersect(b)


def flagged_rankings(products: DataFrame, n: int = 10) -> DataFrame:
    """Both rankings with a mark on products found in both."""
    both = in_both_rankings(products, n).withColumn("both", F.lit(True))
    ranked = [
        top_n(products, col, n, "stock_code").select(
            F.lit(col).alias("ranking"), "stock_code", "product", F.col(col).cast("double").alias("value"))
        for col in ("units", "revenue")]
    return (
        ranked[0].unionByName(ranked[1]).join(both, "stock_code", "left")
        .withColumn("in_both", F.coalesce("both", F.lit(False))).drop("both")
    )


def top_product_trend(clean: DataFrame, products: DataFrame, cutoff: str, n: int = 5) -> DataFrame:
    """Monthly revenue of the n best products; months without a sale of one show 0."""
    # n rows by construction of the limit, so both broadcasts have a fixed size.
    best = F.broadcast(top_n(products, "revenue", n, "stock_code").select("stock_code", "product"))
    sold = (
        clean.where(F.col("invoice_ts") < ntz(cutoff))
        .join(best.select("stock_code"), "stock_code", "left_semi")
        .groupBy(month_start(F.col("invoice_ts")).alias("month"), "stock_code")
        .agg(sum_money(F.col("revenue")).alias("revenue"))
    )
    # Every (month with a sale, best product) pair: the n products ride along as an array.
    names = best.agg(F.collect_list(F.struct("stock_code", "product"))).scalar()
    grid = sold.select("month").distinct().select("month", F.explode(names).alias("p")).select(
        "month", "p.stock_code", "p.product")
    return (
        grid.join(sold, ["month", "stock_code"], "left")
        .select(F.date_format("month", "yyyy-MM").alias("month"), "stock_code", "product",
                F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
        .orderBy("month", "stock_code")
    )


def top_product_pivot(trend: DataFrame, codes: list[str]) -> DataFrame:
    """The trend as a table with one column per product; the caller names the codes."""
    return trend.groupBy("month").pivot("stock_code", codes).agg(F.sum("revenue")).na.fill(0.0)
