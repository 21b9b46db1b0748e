"""Daily revenue series, calendar features and the forecasts made from them.

The series has one row per trading day, so its size is bounded by the calendar whatever
the number of invoice lines; only ``daily_sales`` reads the lines. That is why a window
over all days and a fit on a single partition are fine here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.functions.columns import from_units, money_units, ratio, sum_money
from tillwork.operators.tuning import mean_and_std, run_parallel
from tillwork.params import (
    CALENDAR, FOLDS, FOREST_DEPTH, FOREST_MIN_LEAF, FOREST_TREES, SEASON_DAYS, SEED,
)

UNLIMITED_DEPTH = 30  # the deepest tree MLlib grows
FOREST_BINS = 64      # more than any calendar feature has values, so every split is exact


def daily_sales(clean: DataFrame) -> DataFrame:
    """Revenue per trading day; days without sales have no row."""
    return clean.groupBy(F.col("invoice_ts").cast("date").alias("day")).agg(
        sum_money(F.col("revenue")).alias("revenue"))


def drop_last_day(daily: DataFrame) -> DataFrame:
    """Leave out the last day, whose data end before closing time."""
    return daily.where(F.col("day") < daily.agg(F.max("day")).scalar())


def calendar_features(daily: DataFrame) -> DataFrame:
    return daily.withColumns({
        "weekday": F.weekday("day"), "month": F.month("day"),
        "iso_week": F.weekofyear("day"), "month_day": F.dayofmonth("day")})


def daily_headline(daily: DataFrame) -> DataFrame:
    return daily.agg(F.count("*").alias("trading_days"), F.min("day").alias("first_day"),
                     F.max("day").alias("last_day"))


def temporal_split(daily: DataFrame, cut: str) -> tuple[DataFrame, DataFrame]:
    first_test = F.lit(cut).cast("date")
    return daily.where(F.col("day") < first_test), daily.where(F.col("day") >= first_test)


def split_headline(daily: DataFrame, cut: str) -> DataFrame:
    test = F.col("day") >= F.lit(cut).cast("date")
    return daily.agg(
        F.count_if(~test).alias("train_days"), F.count_if(test).alias("test_days"),
        F.min(F.when(test, F.col("day"))).alias("first_test"),
        F.max(F.when(test, F.col("day"))).alias("last_test"))


def dummies(daily: DataFrame) -> DataFrame:
    """Weekday and month as 0/1 columns, first level left out."""
    return daily.withColumns(
        {f"weekday_{d}": (F.col("weekday") == d).cast("int") for d in range(1, 7)}
        | {f"month_{m}": (F.col("month") == m).cast("int") for m in range(2, 13)})


DUMMY_COLUMNS = [f"weekday_{d}" for d in range(1, 7)] + [f"month_{m}" for m in range(2, 13)]


def seasonal_naive(daily: DataFrame, cut: str, lag: int = SEASON_DAYS) -> DataFrame:
    """Test days predicted by the same weekday 52 weeks before.

    A join on the calendar date, not a lag by rows: days are missing from the series.
    Without that day the training mean stands in; ``has_lag`` tells which it was.
    """
    train, test = temporal_split(daily, cut)
    mean = train.agg(ratio(F.sum(money_units(F.col("revenue"))), F.count("*"))).scalar() / F.lit(10_000.0)
    year_ago = daily.select(F.date_add("day", lag).alias("day"), F.col("revenue").alias("_lagged"))
    return test.join(year_ago, "day", "left").select(
        "day", "revenue", F.coalesce("_lagged", mean).alias("prediction"),
        F.col("_lagged").isNotNull().alias("has_lag"))


def forecast_metrics(scored: DataFrame, actual: str = "revenue", predicted: str = "prediction",
                     by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, R2 against the test mean, and the error of the total in percent."""
    a, p = F.col(actual), F.col(predicted)
    sst = F.var_pop(a) * F.count("*")
    return scored.groupBy(*by).agg(
        F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        (1 - F.try_divide(F.sum((a - p) * (a - p)), sst)).alias("r2"),
        ((ratio(F.sum(p), F.sum(a)) - 1) * 100).alias("total_error_pct"))


def monthly_forecast(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Actual and predicted sums per month."""
    return scored.groupBy(F.trunc("day", "month").alias("month")).agg(
        *[from_units(F.sum(money_units(F.col(c)))).alias(c) for c in columns]).orderBy("month")


# Models ---------------------------------------------------------------------------------

def _features(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def fit_linear(train: DataFrame):
    """Ordinary least squares on the indicator columns."""
    return LinearRegression(labelCol="revenue", regParam=0.0, solver="normal").fit(
        _features(dummies(train), DUMMY_COLUMNS))


def predict_linear(model, df: DataFrame) -> DataFrame:
    return model.transform(_features(dummies(df), DUMMY_COLUMNS)).drop("features", *DUMMY_COLUMNS)


@dataclass(frozen=True)
class ForestSetting:
    trees: int = 100
    depth: int | None = None
    min_leaf: int = 1


FOREST_GRID = [ForestSetting(t, d, m) for t in FOREST_TREES for d in FOREST_DEPTH for m in FOREST_MIN_LEAF]


class _MemberModel(RandomForestRegressionModel):
    """Without ``trees``: PySpark reads every property of a new model, and that one wraps
    each tree in a Python object, which takes longer than growing a shallow forest."""

    trees = ()


class _Member(RandomForestRegressor):
    def _create_model(self, java_model):
        return _MemberModel(java_model)


class Forest:
    """A forest on the four calendar numbers, all of them considered at every split.

    Trees are grown independently, so a forest of 300 is kept as three forests of 100
    with seeds of their own: the search gets the forest of 100 trees from the first of
    them, and the three can be fitted side by side.
    """

    MEMBER = 100

    def __init__(self, train: DataFrame, setting: ForestSetting = ForestSetting(), seed: int = SEED):
        rows = _features(train, CALENDAR).select("features", "revenue")
        sizes = [min(self.MEMBER, setting.trees - i) for i in range(0, setting.trees, self.MEMBER)]
        def grow(member):
            i, n = member
            return _Member(
                labelCol="revenue", numTrees=n, maxDepth=setting.depth or UNLIMITED_DEPTH,
                minInstancesPerNode=setting.min_leaf, featureSubsetStrategy="all", maxBins=FOREST_BINS,
                cacheNodeIds=True, seed=seed + i).fit(rows)

        self.members = run_parallel(train.sparkSession, grow, list(enumerate(sizes)), len(sizes))

    def predict(self, df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
        """Add predictions: of all trees, or per column name of the first so many trees."""
        out = _features(df, CALENDAR)
        for i, member in enumerate(self.members):
            out = member.setPredictionCol(f"_m{i}").transform(out)
        weights = [m.getNumTrees for m in self.members]
        for name, trees in (sizes or {"prediction": sum(weights)}).items():
            used, used_weights = [], []
            for i, w in enumerate(weights):
                if sum(used_weights) < trees:
                    used.append(F.col(f"_m{i}") * w)
                    used_weights.append(w)
            if sum(used_weights) != trees:
                raise ValueError(f"a forest of members {weights} holds no {trees} trees")
            out = out.withColumn(name, sum(used[1:], used[0]) / sum(used_weights))
        return out.drop("features", *[f"_m{i}" for i in range(len(self.members))])

    def importances(self) -> dict[str, float]:
        total = [0.0] * len(CALENDAR)
        for m in self.members:
            for i, v in enumerate(m.featureImportances.toArray()):
                total[i] += float(v) * m.getNumTrees
        return {f: v / sum(total) for f, v in zip(CALENDAR, total)}


def expanding_folds(train: DataFrame, n_splits: int = FOLDS) -> list[tuple[DataFrame, DataFrame]]:
    """(training rows, test rows) pairs in which training always ends before the test.

    Folds count trading days, not calendar spans: with n days and s splits the last
    s blocks of n // (s + 1) days are tested, each on everything before it.
    """
    # One row per trading day: the calendar bounds what this window sorts.
    numbered = train.withColumn("_no", F.row_number().over(W.orderBy("day")) - 1).persist()
    n = numbered.count()
    block = n // (n_splits + 1)
    starts = [n - block * (n_splits - i) for i in range(n_splits)]
    return [(numbered.where(F.col("_no") < s),
             numbered.where((F.col("_no") >= s) & (F.col("_no") < s + block))) for s in starts]


def forest_cv(folds, settings: list[ForestSetting], parallelism: int = 4) -> list[dict]:
    """Mean absolute error of every setting over the folds, best first.

    Settings that differ only in the number of trees share one fit, the largest; its
    members are fitted side by side on top of ``parallelism``.
    """
    shapes: dict[tuple, list[int]] = {}
    for s in settings:
        shapes.setdefault((s.depth, s.min_leaf), []).append(s.trees)

    def one(task):
        (depth, min_leaf), (train, test) = task
        trees = shapes[depth, min_leaf]
        forest = Forest(train, ForestSetting(max(trees), depth, min_leaf))
        scored = forest.predict(test, {f"p{n}": n for n in trees})
        row = scored.agg(*[F.avg(F.abs(F.col("revenue") - F.col(f"p{n}"))).alias(f"p{n}") for n in trees]).first()
        return {ForestSetting(n, depth, min_leaf): row[f"p{n}"] for n in trees}

    # Long fits first (deep trees, long folds), so that none of them is left for the end.
    order = sorted(shapes, key=lambda s: (-(s[0] or UNLIMITED_DEPTH), s[1]))
    tasks = [(shape, fold) for shape in order for fold in reversed(folds)]
    results = run_parallel(folds[0][0].sparkSession, one, tasks, parallelism)
    rows = []
    for s in settings:
        mean, std = mean_and_std([r[s] for r in results if s in r])
        rows.append({"trees": s.trees, "max_depth": s.depth, "min_leaf": s.min_leaf,
                     "mae_cv": mean, "mae_cv_std": std})
    return sorted(rows, key=lambda r: r["mae_cv"])


@dataclass
class Outlook:
    """All forecasts of the test days, with the forest search behind one of them."""

    scored: DataFrame          # day, revenue, naive, linear, forest
    cv: list[dict]
    forest: Forest

    def metrics(self) -> DataFrame:
        models = F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction"))
            for m in ("naive", "linear", "forest")]))
        long = self.scored.select("revenue", models.alias("m")).select("revenue", "m.*")
        return forecast_metrics(long, by=("model",))

    def leaderboard(self, n: int = 5) -> list[dict]:
        return [{**r, "max_depth": str(r["max_depth"])} for r in self.cv[:n]]

    def compare(self) -> list[dict]:
        """Error of the default setting (100 trees, no limits) and of the best one."""
        default = next(r for r in self.cv if (r["trees"], r["max_depth"], r["min_leaf"]) == (100, None, 1))
        return [{"mae_cv_default": default["mae_cv"], "mae_cv_tuned": self.cv[0]["mae_cv"]}]

    def importance(self) -> list[dict]:
        rows = [{"feature": f, "importance": v} for f, v in self.forest.importances().items()]
        return sorted(rows, key=lambda r: -r["importance"])


def run_outlook(daily: DataFrame, cut: str, grid: list[ForestSetting] = FOREST_GRID,
                parallelism: int = 4) -> Outlook:
    train, test = temporal_split(daily, cut)
    cv = forest_cv(expanding_folds(train), grid, parallelism)
    best = cv[0]
    forest = Forest(train, ForestSetting(best["trees"], best["max_depth"], best["min_leaf"]))
    linear = fit_linear(train)
    naive = seasonal_naive(daily, cut).select("day", F.col("prediction").alias("naive"))
    scored = predict_linear(linear, test).withColumnRenamed("prediction", "linear")
    scored = forest.predict(scored).withColumnRenamed("prediction", "forest")
    return Outlook(
        scored.select("day", "revenue", "linear", "forest").join(naive, "day"), cv, forest)
