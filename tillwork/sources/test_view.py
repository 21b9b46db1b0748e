"""Invoice lines with planted defects, derived from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.sources.parts import with_file_order

# Which extra copies of a line exist: 1 = exact duplicate, 2 = cancellation.
_KINDS = """filter(array(0, 1, 2), x -> x = 0 OR (x = 1 AND k = 8)
                   OR (x = 2 AND returned AND k % 4 = 0 AND k <> 8))"""


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of FIXTURES.md section 3. Row ids follow the order of the lines in the file."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # All that is needed of a line, as numbers: lines are many, and joins that do not broadcast move them.
    lines = with_file_order(table("lineitem"), "line_no").selectExpr(
        "line_no", "l_orderkey", "l_partkey", "CAST(l_quantity AS BIGINT) AS quantity",
        "CAST((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 100 AS INT) AS k", "l_returnflag = 'R' AS returned")
    # Orders get their country before they meet the lines, so that lines are moved twice, not three times.
    sold = (
        table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(table("customer").select("c_custkey", "c_nationkey"),
              F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation").select("n_nationkey", "n_name"),
              F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    joined = (
        lines
        .join(table("part").select("p_partkey", "p_name", "p_retailprice"),
              F.col("l_partkey") == F.col("p_partkey"))
        .join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return (
        joined
        .withColumn("kind", F.explode(F.expr(_KINDS)))
        .withColumn("code", F.expr("""concat(lpad(CAST(p_partkey AS STRING), 5, '0'),
            CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END)"""))
        .withColumn("qty", F.expr("""quantity *
            CASE WHEN k = 7 THEN -1 ELSE 1 END * CASE WHEN kind = 2 THEN -1 ELSE 1 END"""))
        .withColumn("hours", F.expr("""8 + l_orderkey % 10 +
            CASE WHEN kind <> 2 THEN 0 WHEN k % 8 = 4 THEN -72 ELSE 72 END"""))
        .selectExpr(
            "line_no * 10 + kind AS rid",
            "concat(CASE WHEN kind = 2 THEN 'C' ELSE '' END, CAST(l_orderkey AS STRING)) AS invoice",
            """CASE WHEN k IN (0, 1, 2) THEN lower(code) WHEN k = 3 THEN concat(code, ' ')
                    WHEN k = 4 THEN 'POST' WHEN k = 5 THEN 'DCGS0058' ELSE code END AS stock_code""",
            """CASE WHEN k = 9 THEN NULL WHEN k = 10 THEN concat(p_name, ' ')
                    ELSE p_name END AS description""",
            "qty AS quantity",
            "o_orderdate + INTERVAL '1' HOUR * CAST(hours AS INT) AS invoice_ts",
            "CASE WHEN k = 6 THEN 0.0D ELSE p_retailprice END AS price",
            "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer_id",
            "n_name AS country",
        )
    )


def planted_export(sales: DataFrame) -> DataFrame:
    """The lines as an export would write them, all text, with cells that cannot be read or are missing."""
    line = F.expr("rid div 10")
    return sales.select(
        F.col("invoice").alias("Invoice"), F.col("stock_code").alias("StockCode"),
        F.when(line % 5 == 3, F.concat(F.lit('SET OF "6", '), F.coalesce("description", F.lit("x"))))
        .otherwise(F.col("description")).alias("Description"),
        F.when(line % 97 == 0, "1 000").otherwise(F.col("quantity").cast("string")).alias("Quantity"),
        F.when(line % 89 == 1, "31.31.1998").when(line % 83 == 2, F.lit(None))
        .otherwise(F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss")).alias("InvoiceDate"),
        F.col("price").cast("string").alias("Price"),
        F.when(line % 2 == 0, F.concat(F.col("customer_id").cast("string"), F.lit(".0")))
        .otherwise(F.col("customer_id").cast("string")).alias("Customer ID"), F.col("country").alias("Country"))
