"""Stratified split, model search, and evaluation of the premium classifiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.columns import ratio
from tillwork.operators.quantiles import order_statistics
from tillwork.operators.scaling import Scaler
from tillwork.operators.tuning import compact, mean_and_std, run_parallel
from tillwork.params import (
    CLASS_WEIGHT, FOLDS, LOGISTIC_C, PREDICTORS, SEED, TEST_FRACTION, TREE_DEPTH, TREE_MIN_LEAF,
)
from tillwork.session import shared_folder

TREE_BINS = 256  # split candidates come from a sample of rows once there are more than bins squared


# Splits ---------------------------------------------------------------------------------

def _hash_cuts(df: DataFrame, label: str, key: str, seed: int,
               cuts: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Attach a seeded hash of the key and, per class, the hash found at given ranks.

    Comparing with the hash at a rank splits a class into exact counts. Sorting a class
    by a window would put it in one task, and there are only two classes.
    """
    # Leading hexadecimal digits of a common hash, so that any engine can repeat the split.
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13)
    hashed = df.withColumn("_hash", F.conv(digits, 16, 10).cast("bigint"))
    found = order_statistics(hashed, ["_hash"], cuts, by=[label])
    edges = found.groupBy(label).agg(*[
        F.max(F.when(F.col("rank_name") == c, F.col("value"))).alias(f"_{c}") for c in cuts])
    return hashed.join(F.broadcast(edges), label, "left")  # one row per class


def stratified_split(df: DataFrame, label: str = "premium", key: str = "customer_id",
                     fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Mark an exact share of every class as test rows."""
    cut = {"cut": lambda n: F.bround(n * F.lit(fraction))}
    marked = _hash_cuts(df, label, key, seed, cut)
    return marked.withColumn(
        "in_test", F.col("_hash") < F.coalesce("_cut", F.lit(float("inf")))).drop("_hash", "_cut")


def stratified_folds(df: DataFrame, label: str = "premium", key: str = "customer_id",
                     folds: int = FOLDS, seed: int = SEED + 1) -> DataFrame:
    """Number the rows with folds that hold equal shares of every class."""
    names = [f"edge{i}" for i in range(1, folds)]
    cuts = {nm: (lambda n, i=i: F.floor(n * F.lit(i) / folds)) for i, nm in enumerate(names, 1)}
    marked = _hash_cuts(df, label, key, seed, cuts)
    above = [F.coalesce(F.col("_hash") >= F.col(f"_{nm}"), F.lit(False)).cast("int") for nm in names]
    fold = sum(above[1:], above[0])
    return marked.withColumn("fold", fold).drop("_hash", *[f"_{nm}" for nm in names])


def split_summary(split: DataFrame) -> DataFrame:
    """Sizes, share of the positive class, and the accuracy of always saying the other."""
    positive = F.avg(F.when(F.col("in_test"), F.col("premium")))
    return split.agg(
        F.count_if(~F.col("in_test")).alias("train_rows"), F.count_if("in_test").alias("test_rows"),
        (positive * 100).alias("pct_premium_test"), ((1 - positive) * 100).alias("pct_majority"))


# Metrics --------------------------------------------------------------------------------

def confusion_matrix(scored: DataFrame, label: str = "premium", predicted: str = "prediction") -> DataFrame:
    """Rows (actual, predicted, n) for every pair of classes, also the empty ones."""
    counts = scored.groupBy(F.col(label).cast("int").alias("actual"),
                            F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    pairs = scored.sparkSession.range(1).select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("actual")).select(
        "actual", F.explode(F.array(F.lit(0), F.lit(1))).alias("predicted"))
    return pairs.join(counts, ["actual", "predicted"], "left").na.fill({"n": 0})


def classification_metrics(scored: DataFrame, label: str = "premium",
                           predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, the averages, and the accuracy."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    per_class = (
        confusion_matrix(scored, label, predicted)
        .select(F.explode(F.array(
            F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), zero.alias("named"),
                     hit.cast("bigint").alias("hits")),
            F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("named"),
                     zero.alias("hits")))).alias("x")).select("x.*")
        .groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "named", "hits")])
        .withColumn("precision", F.coalesce(ratio(F.col("hits"), F.col("named")), F.lit(0.0)))
        .withColumn("recall", F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0)))
        .withColumn("f1", F.coalesce(
            ratio(2 * F.col("hits"), F.col("support") + F.col("named")), F.lit(0.0)))
    )
    measures = ("precision", "recall", "f1")
    weighted = lambda m: ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))
    accuracy = ratio(F.sum("hits"), F.sum("support"))
    together = per_class.agg(F.array(
        F.struct(F.lit("accuracy").alias("row"), *[accuracy.alias(m) for m in measures],
                 F.sum("support").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), *[F.avg(m).alias(m) for m in measures],
                 F.sum("support").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), *[weighted(m).alias(m) for m in measures],
                 F.sum("support").alias("support"))).alias("rows"))
    names = F.when(F.col("class") == 1, "Premium").otherwise("Normal")
    return per_class.select(names.alias("row"), *measures, "support").unionByName(
        together.select(F.explode("rows").alias("x")).select("x.*"))


# Models ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class LogisticSetting:
    c: float = 1.0
    class_weight: str = "None"


@dataclass(frozen=True)
class TreeSetting:
    max_depth: int = 4
    min_leaf: int = 1
    class_weight: str = "None"


LOGISTIC_GRID = [LogisticSetting(c, w) for c in LOGISTIC_C for w in CLASS_WEIGHT]
TREE_GRID = [TreeSetting(d, m, w) for w in CLASS_WEIGHT for d in TREE_DEPTH for m in TREE_MIN_LEAF]


def assembled(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Add the vectors the models read: ``plain`` and ``scaled`` predictors."""
    scaled = VectorAssembler(inputCols=[f"z_{c}" for c in PREDICTORS], outputCol="scaled").transform(scaler.transform(df))
    return VectorAssembler(inputCols=list(PREDICTORS), outputCol="plain").transform(scaled).select(
        *df.columns, "plain", "scaled")


@dataclass(frozen=True)
class TrainingSet:
    """Rows to fit on, with vectors and class weights worked out once for all fits.

    Weight columns: ``w_None`` is 1, ``w_balanced`` n / (2 * size of the row's class).
    """

    rows: DataFrame
    size: int
    positives: int
    scaler: Scaler

    @classmethod
    def of(cls, rows: DataFrame, label: str = "premium") -> TrainingSet:
        """Counts, scaler and the assembled rows, held until ``release``."""
        n = rows.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
        if not n.p or n.p == n.n:
            raise ValueError(f"{n.n} training rows of which {n.p or 0} are positive: a fit needs both classes")
        scaler = Scaler.fit(rows, PREDICTORS)
        balanced = F.when(F.col(label) == 1, n.n / (2.0 * n.p)).otherwise(n.n / (2.0 * (n.n - n.p)))
        ready = assembled(rows, scaler).select(
            label, "plain", "scaled", F.lit(1.0).alias("w_None"), balanced.alias("w_balanced"))
        return cls(ready.persist(), n.n, n.p, scaler)

    def release(self) -> None:
        self.rows.unpersist()


class _Classifier:
    """A fitted model and the vector it reads."""

    features = "plain"

    def named(self, column: str):
        """The fitted model, writing its prediction to one column and nothing else."""
        return self.fitted.setPredictionCol(column).setRawPredictionCol("").setProbabilityCol("")

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.named("prediction").transform(assembled(df, self.scaler))
        return scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"))


class LogisticModel(_Classifier):
    """L2 logistic regression on standardised predictors."""

    features = "scaled"

    def __init__(self, train: TrainingSet, setting: LogisticSetting):
        self.scaler = train.scaler
        # The penalty of C-form regression: C weighs the summed loss, MLlib averages it.
        penalty = 1.0 / (setting.c * train.size)
        self.fitted = LogisticRegression(
            featuresCol=self.features, labelCol="premium", weightCol=f"w_{setting.class_weight}", regParam=penalty,
            elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-6).fit(train.rows)

    def weights(self) -> dict[str, float]:
        return dict(zip(PREDICTORS, map(float, self.fitted.coefficients)))


class TreeModel(_Classifier):
    """One decision tree on the plain predictors."""

    def __init__(self, train: TrainingSet, setting: TreeSetting):
        self.scaler = train.scaler
        self.fitted = DecisionTreeClassifier(
            featuresCol=self.features, labelCol="premium", weightCol=f"w_{setting.class_weight}", impurity="gini",
            maxBins=TREE_BINS, seed=SEED, maxDepth=setting.max_depth, minInstancesPerNode=setting.min_leaf,
            maxMemoryInMB=1024).fit(train.rows)

    def importances(self) -> dict[str, float]:
        return dict(zip(PREDICTORS, map(float, self.fitted.featureImportances.toArray())))

    def rules(self, levels: int = 4) -> str:
        """The tree as nested conditions, without the branches below ``levels`` questions."""
        text = self.fitted.toDebugString
        for i in reversed(range(len(PREDICTORS))):
            text = text.replace(f"feature {i} ", f"{PREDICTORS[i]} ")
        lines = text.rstrip().split("\n")[1:]  # the first line names the object, not the tree
        depth = lambda line: len(line) - len(line.lstrip()) - 2
        return "\n".join(line[2:] for line in lines if depth(line) <= levels)


def make_model(train: TrainingSet, setting):
    return (LogisticModel if isinstance(setting, LogisticSetting) else TreeModel)(train, setting)


def make_folds(train: DataFrame, folds: int = FOLDS) -> list[tuple[TrainingSet, DataFrame]]:
    shared_folder(train.sparkSession)
    # Hundreds of fits start from these rows; the checkpoint keeps their plans short.
    numbered = stratified_folds(train, folds=folds).checkpoint()
    numbered = compact(numbered, numbered.count()).persist()
    return [(TrainingSet.of(numbered.where(F.col("fold") != i)), numbered.where(F.col("fold") == i))
            for i in range(folds)]


def f1_scores(models: Sequence[_Classifier], held_out: DataFrame, scaler: Scaler, label: str = "premium") -> list[float]:
    """Positive F1 of many models on the same rows, in one pass."""
    scored = assembled(held_out.select(label, *PREDICTORS), scaler)
    for i, m in enumerate(models):
        scored = m.named(f"p{i}").transform(scored)
    yes = F.col(label) == 1
    row = scored.agg(F.count_if(yes).alias("actual"), *[x for i in range(len(models)) for x in (
        F.count_if(yes & (F.col(f"p{i}") == 1)).alias(f"hits{i}"), F.count_if(F.col(f"p{i}") == 1).alias(f"named{i}"))]).first()
    return [2 * row[f"hits{i}"] / (row.actual + row[f"named{i}"]) if row.actual + row[f"named{i}"] else 0.0
            for i in range(len(models))]


def cross_validate(folds, settings: list, parallelism: int = 8) -> list[dict]:
    """Mean and deviation of the positive F1 of every setting, best first.

    All fits run side by side; each fold's held-out rows are then scored by all its models at once.
    """
    spark = folds[0][1].sparkSession
    tasks = [(s, train) for train, _ in folds for s in settings]
    models = run_parallel(spark, lambda t: make_model(t[1], t[0]), tasks, parallelism)
    by_fold = [models[i * len(settings):(i + 1) * len(settings)] for i in range(len(folds))]
    scores = run_parallel(spark, lambda t: f1_scores(t[0], t[1][1], t[1][0].scaler), list(zip(by_fold, folds)), parallelism)
    rows = []
    for i, s in enumerate(settings):
        mean, std = mean_and_std([fold[i] for fold in scores])
        rows.append({"setting": s, "f1_cv": mean, "f1_cv_std": std})
    return sorted(rows, key=lambda r: -r["f1_cv"])


def leaderboard(cv: list[dict], n: int = 5) -> list[dict]:
    return [{**vars(r["setting"]), "f1_cv": r["f1_cv"], "f1_cv_std": r["f1_cv_std"]} for r in cv[:n]]


@dataclass
class Study:
    """The whole model comparison of one labelled customer table."""

    split: DataFrame
    train: TrainingSet
    test: DataFrame
    logistic_cv: list[dict]
    tree_cv: list[dict]
    logistic: LogisticModel
    tree: TreeModel

    def scored(self, model: str) -> DataFrame:
        return getattr(self, model).predict(self.test)

    def compare(self) -> list[dict]:
        """Cross-validated F1 of the initial setting and of the best one."""
        out = []
        for name, cv, first in (("logistic", self.logistic_cv, LogisticSetting()),
                                ("tree", self.tree_cv, TreeSetting())):
            initial = next(r["f1_cv"] for r in cv if r["setting"] == first)
            out.append({"model": name, "f1_cv_initial": initial, "f1_cv_tuned": cv[0]["f1_cv"],
                        "gain": cv[0]["f1_cv"] - initial})
        return out

    def importance(self) -> list[dict]:
        weights, importances = self.logistic.weights(), self.tree.importances()
        rows = [{"feature": f, "logistic_coefficient": weights[f], "tree_importance": importances[f]}
                for f in PREDICTORS]
        return sorted(rows, key=lambda r: -r["tree_importance"])


def run_study(customers: DataFrame, parallelism: int = 8) -> Study:
    """Split, search both grids on the training rows, refit the best, keep the test rows apart."""
    shared_folder(customers.sparkSession)
    split = stratified_split(
        customers.select("customer_id", "premium", *PREDICTORS)).checkpoint().persist()
    train, test = split.where(~F.col("in_test")), split.where("in_test")
    folds = make_folds(train)
    logistic_cv = cross_validate(folds, LOGISTIC_GRID, parallelism)
    tree_cv = cross_validate(folds, TREE_GRID, parallelism)
    for held, _ in folds:
        held.release()
    fit_on = TrainingSet.of(train)
    return Study(split, fit_on, test, logistic_cv, tree_cv,
                 LogisticModel(fit_on, logistic_cv[0]["setting"]), TreeModel(fit_on, tree_cv[0]["setting"]))
