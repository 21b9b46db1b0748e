import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from tillwork.operators import bandwidth, classify, forecast, kmeans, meanshift, pairwise, scaling, segment
from tillwork.operators.tuning import run_parallel
from tillwork.params import PREDICTORS

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def shoppers(spark):
    """Customers whose label depends on frequency, with noise."""
    n = 600
    pdf = pd.DataFrame({
        "customer_id": np.arange(n), "frequency": RNG.poisson(5, n) + 1, "recency": RNG.integers(0, 700, n),
        "tenure": RNG.integers(0, 700, n), "distinct_products": RNG.integers(1, 200, n),
        "lines_per_invoice": RNG.uniform(1, 40, n), "is_home": RNG.integers(0, 2, n)})
    pdf["premium"] = (pdf.frequency + RNG.normal(0, 0.7, n) > 7.5).astype(int)
    return spark.createDataFrame(pdf).cache(), pdf


def test_split_and_folds_are_exact(shoppers):
    df, pdf = shoppers
    split = classify.stratified_split(df).toPandas()
    for label, part in split.groupby("premium"):
        assert part.in_test.sum() == round(0.2 * len(part))
    folds = classify.stratified_folds(df).toPandas()
    sizes = folds.groupby(["premium", "fold"]).size().unstack()
    assert sizes.shape == (2, 5) and (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    again = classify.stratified_split(df.repartition(5)).toPandas().set_index("customer_id").in_test
    assert again.sort_index().equals(split.set_index("customer_id").in_test.sort_index())


@pytest.mark.parametrize("weight", ["None", "balanced"])
def test_logistic_solves_the_penalised_problem(shoppers, weight):
    df, pdf = shoppers
    train = classify.TrainingSet.of(df)
    model = classify.LogisticModel(train, classify.LogisticSetting(0.1, weight))
    x = pdf[list(PREDICTORS)].to_numpy(float)
    x = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
    y, n, p = pdf.premium.to_numpy(), len(pdf), pdf.premium.sum()
    w = np.ones(n) if weight == "None" else np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    beta, ridge = np.zeros(7), np.diag([1.0] * 6 + [0.0]) / 0.1
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (w * mu * (1 - mu))[:, None]) + ridge, x.T @ (w * (mu - y)) + ridge @ beta)
    assert list(model.weights().values()) == pytest.approx(beta[:6], abs=2e-3)


def test_search_and_study(shoppers):
    df, pdf = shoppers
    folds = classify.make_folds(df, 3)
    cv = classify.cross_validate(folds, [classify.TreeSetting(2, 10), classify.LogisticSetting(1.0)])
    assert cv[0]["f1_cv"] >= cv[1]["f1_cv"] > 0.7
    tree = classify.TreeModel(classify.TrainingSet.of(df), classify.TreeSetting(2, 10))
    assert max(tree.importances(), key=tree.importances().get) == "frequency"
    rules = tree.rules().split("\n")
    assert rules[0].startswith("If (frequency <=") and not any("feature" in line for line in rules)
    assert len(tree.rules(0).split("\n")) == 2 and len(rules) > 2


def test_metrics(spark):
    rows = [(1, 1)] * 8 + [(1, 0)] * 2 + [(0, 1)] * 4 + [(0, 0)] * 86
    df = spark.createDataFrame(rows, "premium int, prediction int")
    got = {r.row: r for r in classify.classification_metrics(df).collect()}
    assert got["Premium"].precision == pytest.approx(8 / 12) and got["Premium"].recall == pytest.approx(0.8)
    assert got["accuracy"].f1 == pytest.approx(0.94) and got["Normal"].support == 90
    assert got["weighted avg"].recall == pytest.approx(0.94)
    assert got["macro avg"].recall == pytest.approx((0.8 + 86 / 90) / 2)
    empty = {r.row: r for r in classify.classification_metrics(df.withColumn("prediction", F.lit(0))).collect()}
    assert empty["Premium"].precision == 0.0 and empty["Premium"].f1 == 0.0


# Segments -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def cloud(spark):
    xs = np.vstack([RNG.normal(c, 0.6, (70, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2))])
    df = spark.createDataFrame(
        [(i, [float(v) for v in x], i % 2, int(i // 70)) for i, x in enumerate(xs)],
        "customer_id bigint, x array<double>, noise int, blob int").cache()
    dist = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1))
    return df, xs, dist


def _silhouette(dist, labels):
    out = []
    for i, own in enumerate(labels):
        if (labels == own).sum() == 1:
            out.append(0.0)
            continue
        a = dist[i, labels == own].sum() / ((labels == own).sum() - 1)
        b = min(dist[i, labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes(cloud, monkeypatch):
    df, xs, dist = cloud
    single = df.withColumn("one", F.lit(0)).withColumn("alone", F.when(F.col("customer_id") == 3, 1).otherwise(0))
    want = {"noise": _silhouette(dist, np.arange(210) % 2), "blob": _silhouette(dist, np.arange(210) // 70),
            "alone": _silhouette(dist, (np.arange(210) == 3).astype(int))}
    for block in (2048, 50):  # one block, then several
        monkeypatch.setattr(pairwise, "BLOCK_ROWS", block)
        got = pairwise.silhouettes(single, ["noise", "blob", "one", "alone"])
        assert got["one"] is None
        assert {k: got[k] for k in want} == pytest.approx(want)


def test_silhouettes_compare_equal_points_once(cloud, monkeypatch):
    df, xs, dist = cloud
    thrice = df.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 50)
    monkeypatch.setattr(pairwise, "TILE_ROWS", 16)
    seen, plain = [], pairwise.block_sums
    monkeypatch.setattr(pairwise, "block_sums", lambda packs, blocks, offsets: seen.append(blocks) or plain(packs, blocks, offsets))
    got = pairwise.silhouettes(thrice, ["blob"])["blob"]
    assert got == pytest.approx(_silhouette(np.repeat(np.repeat(dist, 3, 0), 3, 1), np.repeat(np.arange(210) // 70, 3)))
    assert seen == [5]  # 210 different points


def test_silhouettes_send_no_block_through_the_driver(cloud, monkeypatch):
    """Copies of blocks are many; a packed table below the threshold says nothing about their size."""
    df, _, dist = cloud
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 20)
    monkeypatch.setattr(pairwise, "RUN", 2)
    plans, plain = [], pairwise.block_sums

    def block_sums(packs, blocks, offsets):
        out = plain(packs, blocks, offsets)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(pairwise, "block_sums", block_sums)
    for blocks in (11, 12):  # rings of odd and even length
        points = df.limit(blocks * 20 - 10)
        own = [r.customer_id for r in points.select("customer_id").collect()]
        got = pairwise.silhouettes(points, ["blob"])["blob"]
        assert got == pytest.approx(_silhouette(dist[np.ix_(own, own)], np.array(own) // 70))
    assert len(plans) == 2 and not [p for p in plans if "Broadcast" in p]


def test_silhouettes_of_points_close_together(spark):
    """Far from the origin and nearly equal, so that a product of matrices alone would lose their distances."""
    xs = np.array([[1e3 + 1e-7 * (i % 7) * (1 + i // 20), 5.0 + (i // 20) * 1e-6, float(i == 59)] for i in range(60)])
    df = spark.createDataFrame([([float(v) for v in x], i // 20) for i, x in enumerate(xs)], "x array<double>, blob int")
    dist = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1))
    assert pairwise.silhouettes(df, ["blob"])["blob"] == pytest.approx(_silhouette(dist, np.arange(60) // 20), abs=1e-6)


@pytest.mark.parametrize("leaf, depth", [(16, 20), (16, 2)])  # leaves by size; crowded leaves dealt into parts
def test_bandwidths(spark, cloud, monkeypatch, leaf, depth):
    monkeypatch.setattr(bandwidth, "LEAF", leaf)
    monkeypatch.setattr(bandwidth, "DEPTH", depth)
    _, xs, _ = cloud
    xs = np.vstack([xs, np.round(xs[:60], 1), xs[:20], np.repeat(xs[:1], 30, axis=0)])  # equal points are weights
    df = spark.createDataFrame([([float(v) for v in x],) for x in xs], "x array<double>")
    ordered = np.sort(np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1)), axis=1)
    want = {q: ordered[:, max(1, int(len(xs) * q)) - 1].mean() for q in (0.001, 0.05, 0.3)}
    assert bandwidth.estimate_bandwidths(df, list(want)) == pytest.approx(want, abs=1e-7)


def test_bandwidth_compares_few_leaves(spark, cloud, monkeypatch):
    monkeypatch.setattr(bandwidth, "LEAF", 4)
    leaves, links = bandwidth.cell_tree(cloud[0])
    n = leaves.count()
    assert leaves.agg(F.max(F.size("points"))).first()[0] <= 4
    assert bandwidth.leaf_pairs(links, [5]).count() < 0.3 * n * n


def test_bandwidth_needs_few_rounds(spark, cloud, monkeypatch):
    """Distances are found, not narrowed down to a width, and the guess leaves little to search."""
    _, xs, _ = cloud
    df = spark.createDataFrame([([float(v) for v in x],) for x in xs], "x array<double>")
    rounds, plain = [], bandwidth._search
    monkeypatch.setattr(bandwidth, "_search", lambda *args: rounds.append(1) or plain(*args))
    ordered = np.sort(np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1)), axis=1)
    want = {q: ordered[:, max(1, int(len(xs) * q)) - 1].mean() for q in (0.05, 0.3)}
    assert bandwidth.estimate_bandwidths(df, list(want)) == pytest.approx(want, abs=1e-12)
    assert len(rounds) < 4


def test_bandwidth_guess_never_changes_the_result(spark, cloud, monkeypatch):
    """Brackets that miss the distance are moved until it is found."""
    _, xs, _ = cloud
    df = spark.createDataFrame([([float(v) for v in x],) for x in xs], "x array<double>")
    plain = bandwidth.guessed
    off = F.transform("low", lambda v: v + 0.05)
    monkeypatch.setattr(bandwidth, "guessed", lambda *args: plain(*args).withColumns({"low": off, "high": off}))
    ordered = np.sort(np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1)), axis=1)
    want = {q: ordered[:, max(1, int(len(xs) * q)) - 1].mean() for q in (0.05, 0.3)}
    assert bandwidth.estimate_bandwidths(df, list(want)) == pytest.approx(want, abs=1e-9)


def test_bandwidth_of_equal_points(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 9, "x array<double>")
    assert bandwidth.estimate_bandwidths(df, [0.1, 1.0]) == {0.1: 0.0, 1.0: 0.0}


def _reference_mean_shift(xs, h):
    """Plain NumPy statement of flat-kernel Mean Shift with grid seeds."""
    final = {}
    for seed in np.unique(np.rint(xs / h), axis=0) * h:
        for step in range(301):
            inside = xs[np.linalg.norm(xs - seed, axis=1) <= h]
            old, seed = seed, inside.mean(axis=0)
            if np.linalg.norm(seed - old) <= 1e-3 * h:
                break
        final[tuple(seed)] = len(inside)
    centres = []
    for c, _ in sorted(final.items(), key=lambda t: (t[1], t[0]), reverse=True):
        if all(np.linalg.norm(np.array(c) - k) > h for k in centres):
            centres.append(np.array(c))
    return np.linalg.norm(xs[:, None] - np.array(centres)[None], axis=2).argmin(axis=1)


def test_mean_shift(cloud):
    df, xs, _ = cloud
    bandwidths = {0.1: 1.1, 0.2: 2.4}
    labelled, columns, unsettled = meanshift.mean_shift(df, bandwidths)
    assert unsettled == {0.1: 0, 0.2: 0}
    assert sum(meanshift.mean_shift(df, bandwidths, 0)[2].values()) > 0
    got = labelled.orderBy("customer_id").toPandas()
    for q, h in bandwidths.items():
        assert got[columns[q]].tolist() == _reference_mean_shift(xs, h).tolist()
    assert got["ms_1"].nunique() == 3


def test_mean_shift_leaves_resting_seeds_alone(cloud, monkeypatch):
    sizes, plain = [], meanshift._written

    def written(table):
        out = plain(table)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(meanshift, "_written", written)
    seeds = meanshift.shift_seeds(cloud[0], {0.1: 1.1, 0.2: 2.4})
    first, *rounds, last = sizes
    assert last == first == seeds.count() and seeds.filter("not rest").isEmpty()
    assert rounds == sorted(rounds, reverse=True) and rounds[-1] < first


def test_mean_shift_of_few_seeds_is_that_of_the_join(cloud, monkeypatch):
    df, xs, _ = cloud
    twice = df.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2))))
    bandwidths = {0.1: 1.1, 0.2: 2.4}
    for rounds in (300, 1):
        plain = meanshift.shift_seeds(twice, bandwidths, rounds).toPandas()
        monkeypatch.setattr(meanshift, "MANY_POINTS", 100)
        monkeypatch.setattr(meanshift, "SEEDS_AT_ONCE", 7)
        asked, passes = [], meanshift.one_pass
        monkeypatch.setattr(meanshift, "one_pass", lambda *args: asked.append(1) or passes(*args))
        few = meanshift.shift_seeds(twice, bandwidths, rounds).toPandas()
        monkeypatch.undo()
        assert 0 < len(asked) <= rounds + 1
        key = ["q", "s0", "s1", "s2"]
        plain, few = plain.sort_values(key).reset_index(drop=True), few.sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(few[plain.columns], plain, check_exact=False, rtol=1e-12, atol=1e-12)


def test_kmeans_fits_all_models_in_one_loop(cloud, monkeypatch):
    """Jobs follow the slowest model, not the number of models; more centres than points are left out."""
    df, xs, _ = cloud
    passes, plain = [], kmeans.one_pass
    monkeypatch.setattr(kmeans, "one_pass", lambda *args: passes.append(1) or plain(*args))
    models = segment.kmeans_best(segment.with_vector(df), [2, 3, 4], 10)
    assert len(passes) < 60
    away = ((xs[:, None] - models[3].centres[None]) ** 2).sum(2).min(1)
    assert models[3].summary.trainingCost == pytest.approx(away.sum())
    two = df.where("customer_id < 2").crossJoin(df.sparkSession.range(3).select(F.lit(1).alias("_n")))
    few = segment.kmeans_best(segment.with_vector(two), [2, 5], 2)
    assert [len(few[k].centres) for k in (2, 5)] == [2, 2] and few[5].summary.trainingCost == pytest.approx(0, abs=1e-12)


def test_kmeans_vectors_are_kept_by_the_fit(cloud, monkeypatch):
    df = cloud[0].selectExpr("customer_id", "1 + abs(x[0]) AS recency", "1 + abs(x[1]) AS frequency", "1 + abs(x[2]) AS revenue",
                             "noise AS premium")

    class Seen(Exception):
        pass

    def fit(vectors, *args, **kwargs):
        raise Seen(vectors.storageLevel.useMemory)

    monkeypatch.setattr(segment, "kmeans_best", fit)
    with pytest.raises(Seen) as found:
        segment.run_segmentation(df)
    assert found.value.args == (False,)


def test_silhouettes_take_gaps_between_labels(cloud):
    df, _, _ = cloud
    gaps = df.withColumn("wide", F.col("blob") * 2 + 1)
    got = pairwise.silhouettes(gaps, ["blob", "wide"])
    assert got["wide"] == pytest.approx(got["blob"])


def test_kmeans_sweep_and_relabel(cloud):
    df, xs, _ = cloud
    models = segment.kmeans_best(segment.with_vector(df), [2, 3, 4], 3)
    costs = [models[k].summary.trainingCost for k in (2, 3, 4)]
    assert costs == sorted(costs, reverse=True)
    out = segment.apply_kmeans(df, models).withColumn("revenue", 100.0 - F.col("blob") * 10)
    assert out.groupBy("blob").agg(F.countDistinct("km_3").alias("n")).where("n > 1").count() == 0
    renamed = segment.relabel_by_median(out, "km_3").groupBy("km_3").agg(F.first("blob").alias("b")).collect()
    assert {r.km_3: r.b for r in renamed} == {0: 2, 1: 1, 2: 0}
    found = segment.squared_silhouettes(out.withColumn("gap", F.col("km_3") * 2).withColumn("one", F.lit(4)), ["km_3", "gap", "one"])
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="km_3", metricName="silhouette")
    assert found["km_3"] == pytest.approx(evaluator.evaluate(segment.with_vector(out)), abs=1e-9) and found["km_3"] > 0.8
    assert found["gap"] == pytest.approx(found["km_3"]) and found["one"] is None


def test_relabelling_two_groupings_keeps_the_plan_short(cloud):
    df = cloud[0].withColumn("revenue", 100.0 - F.col("blob") * 10 - F.col("noise"))
    both = segment.relabel_by_median(df, "blob", "noise")
    nested = segment.relabel_by_median(segment.relabel_by_median(df, "blob"), "noise")
    rows = lambda out: sorted(out.select("customer_id", "blob", "noise").collect())
    assert rows(both) == rows(nested)
    exchanges = lambda out: out._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(both) < 2.5 * exchanges(segment.relabel_by_median(df, "blob"))


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    got = scaling.standardize(df, ["a", "b"]).toPandas()
    assert got.z_a.tolist() == pytest.approx(((np.array([1, 2, 6]) - 3) / np.std([1, 2, 6])).tolist())
    assert (got.z_b == 0).all()  # a constant column divides by 1


# Forecast -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def series(spark):
    days = pd.date_range("2010-01-01", "2011-06-30").difference(pd.DatetimeIndex(["2010-03-01"]))
    pdf = pd.DataFrame({"day": days.date, "revenue": 100.0 + 20 * days.dayofweek + 5 * days.month})
    return forecast.calendar_features(spark.createDataFrame(pdf)).cache(), pdf


def test_expanding_folds(spark):
    days = pd.date_range("2010-01-01", periods=518).date
    folds = forecast.expanding_folds(spark.createDataFrame(pd.DataFrame({"day": days, "revenue": 1.0})))
    assert [(a.count(), b.count()) for a, b in folds] == [(n, 86) for n in (88, 174, 260, 346, 432)]
    assert all(a.agg(F.max("day")).first()[0] < b.agg(F.min("day")).first()[0] for a, b in folds)


def test_seasonal_naive(series):
    df, pdf = series
    scored = forecast.seasonal_naive(df, "2011-01-01").toPandas().set_index("day")
    value = pdf.set_index("day").revenue
    train_mean = value[[d for d in value.index if d < pd.Timestamp("2011-01-01").date()]].mean()
    for day, row in scored.iterrows():
        lagged = (pd.Timestamp(day) - pd.Timedelta(days=364)).date()
        assert row.has_lag == (lagged in value.index)
        assert row.prediction == pytest.approx(value.get(lagged, train_mean))
    assert (~scored.has_lag).sum() == 1


def test_linear_model_finds_the_calendar(series):
    df, _ = series
    train, test = forecast.temporal_split(df, "2011-01-01")
    row = forecast.forecast_metrics(forecast.predict_linear(forecast.fit_linear(train), test)).first()
    assert row.mae < 1e-6 and row.r2 == pytest.approx(1.0) and abs(row.total_error_pct) < 1e-6


def test_forest_search(series):
    df, _ = series
    grid = [forecast.ForestSetting(t, d, 1) for t in (100, 200) for d in (3, None)]
    out = forecast.run_outlook(df, "2011-01-01", grid)
    assert len(out.cv) == 4 and out.cv[0]["mae_cv"] <= out.cv[-1]["mae_cv"] and out.cv[0]["max_depth"] is None
    metrics = {r.model: r for r in out.metrics().collect()}
    assert set(metrics) == {"naive", "linear", "forest"} and metrics["forest"].r2 > 0.7
    assert sum(r["importance"] for r in out.importance()) == pytest.approx(1.0)
    monthly = forecast.monthly_forecast(out.scored, ["revenue", "naive", "linear", "forest"])
    assert monthly.count() == 6


def test_forecast_metric_definitions(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 17.0), (30.0, 30.0)], "revenue double, prediction double")
    row = forecast.forecast_metrics(df).first()
    assert row.mae == pytest.approx(5 / 3) and row.rmse == pytest.approx((13 / 3) ** 0.5)
    assert row.r2 == pytest.approx(1 - 13 / 200) and row.total_error_pct == pytest.approx((59 / 60 - 1) * 100)


def test_parallel_fits_share_no_local_properties(spark):
    together = threading.Barrier(4, timeout=60)

    def one(i):
        spark.sparkContext.setLocalProperty("test.fit", str(i))
        together.wait()
        return spark.sparkContext.getLocalProperty("test.fit")

    assert run_parallel(spark, one, range(4), 4) == ["0", "1", "2", "3"]
