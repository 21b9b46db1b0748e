"""Stage tables: each is computed once, written as Parquet and read back by what follows.

The order is ingest -> audit (cleaning) -> products / customers / daily series. Writing
the stages cuts the lineage: a lost executor costs tasks of the current stage only.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.operators import clean, customers, forecast, products
from tillwork.params import ONLINE_SHOP, TEST_TABLES, TIME_FORMATS, Params
from tillwork.session import shared_folder
from tillwork.sources.parts import (
    assert_overlap_identical, read_parts, union_parts,
)
from tillwork.sources import load
from tillwork.sources.sinks import write_table
from tillwork.sources.test_view import dirty_sales

# The test data is delivered as two parts that overlap in June 1998.
FIRST_PART_END, SECOND_PART_START = "1998-07-01", "1998-06-01"


class Stages:
    """The stage tables of one data set in one Spark application.

    ``deliver`` returns the two parts of the input, oldest first; every row carries a
    unique ``rid`` that grows with its position in the delivery.
    """

    def __init__(self, spark: SparkSession, name: str,
                 deliver: Callable[[Stages], dict[str, DataFrame]], params: Params,
                 folder: str | None = None):
        digest = hashlib.md5(f"{name}|{params}".encode()).hexdigest()[:12]
        self.spark, self.params, self._deliver = spark, params, deliver
        root = shared_folder(spark)
        self.folder = folder or f"{root}/tillwork/{spark.sparkContext.applicationId}/{digest}"
        self._schemas: dict[str, T.StructType] = {}
        self._memo: dict[str, object] = {}
        self._lock = threading.RLock()

    def stage(self, name: str, build: Callable[[], DataFrame],
              partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> DataFrame:
        """Write the table unless this application has done so; read it back."""
        path = f"{self.folder}/{name}"
        with self._lock:
            if name not in self._schemas:
                df = build()
                write_table(df, path, partition_by, cluster_by)
                self._schemas[name] = df.schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def once(self, name: str, build: Callable[[], object]):
        """Keep a driver-side result, such as fitted models, for the application."""
        with self._lock:
            if name not in self._memo:
                self._memo[name] = build()
            return self._memo[name]

    def parts(self) -> dict[str, DataFrame]:
        return self._deliver(self)

    def raw(self) -> DataFrame:
        """Interim table: the parts joined into one after the overlap check."""
        def build():
            first, second = self.parts().values()
            assert_overlap_identical(first, second)
            joined = union_parts(first, second)
            load.assert_nothing_lost(first, second, joined)
            return joined

        return self.stage("raw", build)

    def audited(self) -> DataFrame:
        """Every distinct line with the rule it fails, one directory per rule.

        Inside a rule, lines of a month are written together, so that the statistics of
        the files rule out most of them for a time range; a directory per month would
        be thousands of tiny files on a long, small data set.
        """
        return self.stage("audited", lambda: clean.audit_sales(self.raw()), ["rule"], ["sales_month"])

    def clean(self) -> DataFrame:
        """The clean table: kept lines with trimmed description and revenue, lines of a month together."""
        return self.stage("clean", lambda: clean.clean_sales(self.audited()), cluster_by=["sales_month"])

    def products(self) -> DataFrame:
        return self.stage("products", lambda: products.product_dim(self.clean()))

    def activity(self) -> DataFrame:
        return self.stage("activity", lambda: customers.customer_activity(self.clean()))

    def customers(self) -> DataFrame:
        return self.stage("customers", lambda: customers.with_premium_label(
            customers.customer_features(self.activity(), self.params.home_country)))

    def daily(self) -> DataFrame:
        return self.stage("daily", lambda: forecast.calendar_features(
            forecast.drop_last_day(forecast.daily_sales(self.clean()))))


def from_test_tables(spark: SparkSession, sf_dir: str) -> Stages:
    """Stages over the test tables, whose dirty view is first written as two deliveries."""
    def deliver(s: Stages) -> dict[str, DataFrame]:
        def view():
            in_part = F.array(
                F.when(F.col("invoice_ts") < FIRST_PART_END, 1),
                F.when(F.col("invoice_ts") >= SECOND_PART_START, 2))
            return dirty_sales(spark, sf_dir).withColumn("part", F.explode(F.array_compact(in_part)))

        both = s.stage("parts", view, ["part"])
        schema = T.StructType([f for f in both.schema if f.name != "part"])
        return read_parts(spark, {f"part_{n}": f"{s.folder}/parts/part={n}" for n in (1, 2)}, schema)

    return Stages(spark, sf_dir, deliver, TEST_TABLES)


def delivery(s: Stages, name: str, path: str, number: int, fmt: str = "csv",
             formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """All rows of a delivered part, numbered, good ones and rejected ones.

    The scan is written at once: places in the delivery must not change later.
    """
    found = s.stage(f"{name}_scan", lambda: load.checked(load.scan_export(s.spark, path, fmt), formats))
    return s.stage(f"{name}_rows", lambda: load.with_delivery_ids(found, number))


def from_exports(spark: SparkSession, parts: dict[str, str], params: Params = ONLINE_SHOP,
                 fmt: str = "csv", folder: str | None = None, formats: Sequence[str] = TIME_FORMATS) -> Stages:
    """Stages over two exported parts (headers as the shop writes them), oldest first.

    Rows that cannot be read stay in ``part_<i>_rows`` with their reason.
    """
    def deliver(s: Stages) -> dict[str, DataFrame]:
        return {name: load.good_rows(delivery(s, f"part_{i}", path, i, fmt, formats))
                for i, (name, path) in enumerate(parts.items())}

    return Stages(spark, str(sorted(parts.items())), deliver, params, folder)


_open: dict[tuple[str, str], Stages] = {}
_open_lock = threading.Lock()


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    """The stages of a folder of test tables, shared by all queries of the application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _open_lock:
        if key not in _open:
            _open[key] = from_test_tables(spark, sf_dir)
        return _open[key]
