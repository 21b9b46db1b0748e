"""Fixed values, table schemas and per-dataset parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# They decide which rows survive cleaning.
PRODUCT_PATTERN = r"^\d{5}[A-Z]*$"
PRODUCT_EXCEPTIONS = ("DCGS", "SP1002")
CANCEL_PREFIX = "C"

# The statistics every report shows.
PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
PARETO_SHARES = (0.01, 0.05, 0.10, 0.20)
REVENUE_SHARES = (0.5, 0.8)
LABEL_QUANTILE = 0.80
SEED = 42

# Features of the models and their search grids.
PREDICTORS = ("frequency", "recency", "tenure", "distinct_products", "lines_per_invoice", "is_home")
RFM = ("recency", "frequency", "revenue")
CALENDAR = ("weekday", "month", "iso_week", "month_day")
LOGISTIC_C = (0.01, 0.1, 1.0, 10.0)
TREE_DEPTH = (2, 3, 4, 5, 6, 8)
TREE_MIN_LEAF = (1, 10, 25, 50)
CLASS_WEIGHT = ("None", "balanced")
KMEANS_KS = (2, 3, 4, 5, 6, 7, 8)
KMEANS_CHOSEN = 4
KMEANS_RESTARTS = 10
BANDWIDTH_QUANTILES = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
BANDWIDTH_CHOSEN = 0.20
FOREST_TREES = (100, 300)
FOREST_DEPTH = (None, 5, 10)
FOREST_MIN_LEAF = (1, 5, 10)
FOLDS = 5
TEST_FRACTION = 0.2
SEASON_DAYS = 364

# Money is summed as whole ten-thousandths of the currency unit, so that sums are exact
# and do not depend on the order in which partitions arrive. Prices of 0.001 exist.
MONEY_SCALE = 10_000

BUSINESS_COLUMNS = (
    "invoice", "stock_code", "description", "quantity",
    "invoice_ts", "price", "customer_id", "country",
)

RAW_SCHEMA = T.StructType([
    T.StructField("invoice", T.StringType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("invoice_ts", T.TimestampNTZType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("country", T.StringType()),
])

# The same table as the shop exports it: names with capitals and a blank.
EXPORT_NAMES = {
    "Invoice": "invoice", "StockCode": "stock_code", "Description": "description",
    "Quantity": "quantity", "InvoiceDate": "invoice_ts", "Price": "price",
    "Customer ID": "customer_id", "Country": "country",
}

EXPORT_SCHEMA = T.StructType([
    T.StructField(name, RAW_SCHEMA[new].dataType) for name, new in EXPORT_NAMES.items()])


# Cells a line cannot do without, and how exports write times.
REQUIRED = ("quantity", "invoice_ts", "price")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm")


@dataclass(frozen=True)
class Params:
    """What differs between one data set and another."""

    home_country: str
    years: tuple[int, int]      # commercial years compared (December to November)
    year_cutoff: str            # first instant after the last complete commercial year
    forecast_cut: str           # first test day


# The data set the reports were made for.
ONLINE_SHOP = Params("United Kingdom", (2010, 2011), "2011-12-01", "2011-09-01")
TEST_TABLES = Params("NATION_0", (1999, 2000), "2000-12-01", "2001-01-01")
