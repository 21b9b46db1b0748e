import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwork.operators import concentration, customers, describe, products, quantiles, running, temporal
from tillwork.params import PERCENTILES

RNG = np.random.default_rng(11)


def test_quantiles_equal_numpy(spark):
    n = 4000
    pdf = pd.DataFrame({
        "g": RNG.choice(["a", "b", "c"], n, p=[0.9, 0.09, 0.01]),
        "x": np.round(RNG.lognormal(3, 2, n), 2) * RNG.choice([1, -1], n),
        "y": RNG.choice([0.0, 0.5, 1.0], n, p=[0.7, 0.2, 0.1]),  # one value holds most rows
        "z": 1e9 + RNG.integers(0, 50, n)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    probs = [0.0, *PERCENTILES, 1.0]
    got = {(r.g, r.column, r.prob): r.value for r in quantiles.exact_quantiles(df, ["x", "y", "z"], probs, ["g"]).collect()}
    assert len(got) == 3 * 3 * len(probs)
    for g, part in pdf.groupby("g"):
        for c in "xyz":
            for p in probs:
                assert got[g, c, p] == pytest.approx(part[c].quantile(p), rel=1e-12, abs=1e-9)


def test_quantiles_group_nulls_together(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r.g: r.v for r in quantiles.medians(df, ["v"], ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_order_bucket_never_decreases(spark):
    values = sorted([*RNG.normal(0, 1e6, 500), *RNG.normal(0, 1e-3, 500), 0.0, -1.0, 1.0, 1e300, -1e300])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    buckets = [r.b for r in df.select("i", quantiles.order_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_describe_equals_pandas(spark):
    pdf = pd.DataFrame({"v": np.round(RNG.lognormal(1, 1, 300), 2), "c": 2.0})
    rows = {r.column: r for r in describe.describe_columns(spark.createDataFrame(pdf), ["v", "c"]).collect()}
    v, s = rows["v"], pdf["v"]
    assert (v["count"], v.min, v.max) == (300, s.min(), s.max())
    for got, want in ((v.mean, s.mean()), (v.std, s.std()), (v.skew, s.skew()), (v.kurtosis, s.kurt()),
                      (v.p01, s.quantile(.01)), (v.p50, s.median()), (v.p99, s.quantile(.99))):
        assert got == pytest.approx(want, rel=1e-9)
    assert rows["c"].skew == 0.0 and rows["c"].kurtosis == 0.0


def test_describe_few_values(spark):
    row = describe.describe_columns(spark.createDataFrame([(1.0,), (2.0,)], "v double"), ["v"]).first()
    assert row.skew is None and row.kurtosis is None and row.p50 == 1.5


def test_histogram_counts_every_value_once(spark):
    pdf = pd.DataFrame({"q": RNG.integers(1, 500, 1000), "p": np.round(RNG.lognormal(1, 1, 1000), 2) + 0.01})
    out = describe.log_histogram(spark.createDataFrame(pdf), ["q", "p"], ["q"]).toPandas()
    assert out.groupby("column").lines.sum().to_dict() == {"p": 1000, "q": 1000}
    for c in "qp":
        bins = out[out.column == c].sort_values("bin")
        edges = np.append(bins.lower.to_numpy(), bins.upper.iloc[-1])
        assert bins.lines.tolist() == np.histogram(pdf[c], edges)[0].tolist()
    assert (out[out.column == "q"].lower % 1 == 0).all() and len(out[out.column == "p"]) == 49


def test_running_total_over_the_whole_table(spark):
    pdf = pd.DataFrame({"k": range(500), "v": RNG.integers(1, 4, 500)})  # many ties
    out = running.running_total(
        spark.createDataFrame(pdf).repartition(7), F.col("v"), [F.desc("v"), F.col("k")], "t").toPandas()
    want = pdf.sort_values(["v", "k"], ascending=[False, True])
    assert out.set_index("k").t.to_dict() == dict(zip(want.k, want.v.cumsum()))
    numbers = running.row_numbers(spark.createDataFrame(pdf), [F.col("k")]).toPandas()
    assert (numbers.row_no == numbers.k + 1).all()


@pytest.mark.parametrize("values", [[1.0] * 10, [5.0, 3.0, 2.0], list(np.round(RNG.lognormal(3, 1.5, 400), 2)), [7.5]])
def test_concentration_equals_brute_force(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k int, v double")
    ranked = np.sort(np.round(np.array(values) * 10_000).astype(np.int64))[::-1]
    cum, total = ranked.cumsum(), ranked.sum()
    got = {r.top: (r.customers, r.revenue_share) for r in concentration.pareto_top_share(df, "v", [0.01, 0.05, 0.2]).collect()}
    for p, (k, share) in got.items():
        assert k == max(1, round(p * len(values))) and share == pytest.approx(cum[k - 1] / total)
    reach = {r.share: r.products for r in concentration.items_for_share(df, "v", [0.5, 0.8]).collect()}
    assert reach == {t: int((cum <= t * total).sum()) + 1 for t in (0.5, 0.8)}


def test_share_reached_exactly_counts_one_more(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 20.0)], "k string, v double")
    assert concentration.items_for_share(df, "v", [0.5]).first().products == 2


def test_product_names(spark):
    rows = [("1", "b"), ("1", "a"), ("1", None), ("1", None), ("2", None), ("3", "x"), ("3", "y"), ("3", "y")]
    df = spark.createDataFrame([(c, d, 2, 1.5) for c, d in rows],
                               "stock_code string, description string, quantity bigint, revenue double")
    got = {r.stock_code: (r.product, r.descriptions, r.lines, r.units, r.revenue) for r in products.product_dim(df).collect()}
    assert got == {"1": ("a", 2, 4, 8, 6.0), "2": (None, 0, 1, 2, 1.5), "3": ("y", 2, 3, 6, 4.5)}


def test_pivots_agree_with_long_tables(tables):
    trend = products.top_product_trend(tables.clean(), tables.products(), "2000-12-01").cache()
    codes = sorted(r.stock_code for r in trend.select("stock_code").distinct().collect())
    wide = products.top_product_pivot(trend, codes).toPandas().set_index("month")
    assert len(codes) == 5
    for r in trend.collect():
        assert wide.loc[r.month, r.stock_code] == r.revenue
    counts = temporal.weekday_hour_counts(tables.clean())
    matrix = temporal.weekday_hour_matrix(counts).toPandas().set_index("weekday")
    assert matrix.to_numpy().sum() == temporal.one_per_invoice(tables.clean()).count()


def test_commercial_years(sales):
    from tillwork.operators import clean

    df = clean.clean_sales(clean.audit_sales(sales(
        (1, "1", "10000", 1, "1999-12-31T23:00", 10.0, 1), (2, "2", "10000", 1, "2000-01-01T00:00", 20.0, 1),
        (3, "3", "10000", 1, "2000-12-01T00:00", 40.0, 1), (4, "4", "10000", 1, "1998-12-01T00:00", 5.0, 1))))
    yoy = temporal.yoy_by_month(df, (1999, 2000), "2000-12-01").collect()
    assert [r.month for r in yoy] == [12, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert (yoy[0].first_year, yoy[0].second_year, yoy[0].change_pct) == (5.0, 10.0, 100.0)
    assert (yoy[1].first_year, yoy[1].second_year, yoy[1].change_pct) == (None, 20.0, None)
    assert temporal.partial_month(df, "2000-12-01").first().revenue == 40.0


def test_recency_counts_elapsed_days(sales):
    from tillwork.operators import clean

    df = clean.clean_sales(clean.audit_sales(sales(
        (1, "1", "10000", 1, "2011-12-09T12:50", 10.0, 1), (2, "2", "10000", 1, "2011-12-09T00:00", 20.0, 2),
        (3, "3", "10000", 1, "2011-12-08T00:01", 40.0, 3), (4, "4", "10000", 1, "2011-12-08T00:00", 40.0, None))))
    got = {r.customer_id: (r.recency, r.is_home) for r in customers.customer_features(
        customers.customer_activity(df), "Here").collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (1, 1)}


def test_first_country_by_row_order(spark, sales):
    from tillwork.operators import clean

    df = clean.clean_sales(clean.audit_sales(sales(
        (9, "1", "10000", 1, "2011-01-01T12:50", 10.0, 1, "d", "Late"), (2, "2", "10000", 1, "2011-12-09T00:00", 20.0, 1, "d", "Early"))))
    assert customers.customer_activity(df).first().country == "Early"


def test_table_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a"), (None, "a")], "n bigint, s string")
    got = {r.column: (r.type, r.nulls, r.null_pct, r.distinct_values) for r in describe.table_profile(df).collect()}
    assert got == {"n": ("bigint", 1, 25.0, 2), "s": ("string", 1, 25.0, 1)}
    assert describe.table_profile(df, exact=False).count() == 2


def test_no_window_gathers_a_crowded_bucket(spark):
    """A million distinct values fall into two coarse buckets; what is ordered one by one stays short."""
    from pyspark.sql import functions as F

    from tillwork.operators import quantiles

    df = spark.range(1_000_000).select((F.lit(1.6e9) + F.col("id")).alias("v"))
    counts = quantiles.value_counts(df, ["v"])
    assert counts.groupBy("bucket").count().agg(F.max("count")).first()[0] > 500_000
    found = counts.select("column", "value", "n", F.lit("r").alias("rank_name"), F.lit(10**6).alias("total"), F.lit(123_456).alias("inner_rank"))
    rows = quantiles._narrowed(found, ["column", "rank_name"]).collect()
    assert len(rows) <= 1024 and 1.6e9 + 123_456 in {r.value for r in rows}
    got = {r["prob"]: r["value"] for r in quantiles.exact_quantiles(df, ["v"], [0.25, 0.5]).collect()}
    assert got == {0.25: 1.6e9 + 249_999.75, 0.5: 1.6e9 + 499_999.5}


def test_shares_of_a_crowded_bucket(spark):
    """Amounts so close that they share a bucket: the last window sees a few of them."""
    n = 300_000
    items = spark.range(n).select("id", (F.lit(1_000_000.0) + F.col("id") * 0.001).alias("revenue"))
    amounts, buckets = concentration._ranked_values(items, "revenue")
    assert buckets.count() < 5
    hits = buckets.withColumns({"top": F.lit(0.5), "k": (F.col("n_above") + F.col("n_until")) / 2})
    holds = (F.col("k") > F.col("n_before")) & (F.col("k") <= F.col("n_to"))
    assert concentration._crowd(amounts, hits.where("bn > 1000"), "top", "k", holds).count() < 50
    value = 1_000_000 + np.arange(n)[::-1] * 0.001
    got = [r.revenue_share for r in concentration.pareto_top_share(items, "revenue", (0.01, 0.2, 0.5)).collect()]
    assert got == pytest.approx([value[:round(n * p)].sum() / value.sum() for p in (0.01, 0.2, 0.5)], abs=1e-12)
    found = [r.products for r in concentration.items_for_share(items, "revenue", (0.5, 0.8)).collect()]
    so_far = np.cumsum(value) / value.sum()
    assert found == [int((so_far <= t).sum()) + 1 for t in (0.5, 0.8)]
