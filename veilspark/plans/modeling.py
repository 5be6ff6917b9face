"""Cross-validated model evaluation with Spark ML.

Every model is trained by Spark on distributed rows. Predictions of all parameter sets and
folds are reduced to confusion counts, and all metrics come from those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.relations import at_once
from veilspark.plans.features import Prepared, stratified_folds, stratified_split
from veilspark.plans.metrics import confusion, fold_means, metrics

# The parameter grids.
FULL_GRIDS = {
    "RF": {"trees": (100, 250, 500), "depth": (4, 6, 8, 10)},
    "Bag": {"trees": (100, 250, 500)},
    "XGB": {"trees": (100, 250, 500), "depth": (4, 6, 8, 10), "rate": (0.1, 0.01, 0.001)},
    "LogR": {"c": (1e-4, 1.0, 1e4), "iterations": (10_000, 100_000)},
    "NN": {"layout": (0, 1, 2, 3, 4, 5, 6), "alpha": (5e-3, 1e-3, 1e-4), "iterations": (10_000, 100_000)},
}
# Small grids of the same shape, for trial runs.
QUICK_GRIDS = {
    "RF": {"trees": (10, 20), "depth": (4,)},
    "Bag": {"trees": (5, 10)},
    "XGB": {"trees": (5, 10), "depth": (3,), "rate": (0.1,)},
    "LogR": {"c": (1e-4, 1.0), "iterations": (15,)},
    "NN": {"layout": (0, 1), "alpha": (1e-4,), "iterations": (10,)},
}
MAX_DEPTH = 30
# Training passes over its rows many times; tasks with fewer rows than this are mostly
# overhead, so small training sets are gathered in fewer partitions.
ROWS_PER_TASK = 10_000


def grid(model: str, size: str = "full") -> list[dict[str, float]]:
    """Parameter sets of one learner, in a fixed order."""
    chosen = {"quick": QUICK_GRIDS, "full": FULL_GRIDS}[size][model]
    return [dict(zip(chosen, values)) for values in product(*chosen.values())]


def hidden_layers(layout: int, features: int) -> list[int]:
    """The seven layouts of the network, in terms of the number of features."""
    n, half, third = features, max(features // 2, 1), max(int(features * (2 / 3)), 1)
    # Layouts by number.
    return [[n], [half], [third], [n, half], [n, third], [half, third], [n, half, third]][layout]


def estimator(model: str, params: dict, features: int, classes: int, rows: int, seed: int):
    """Spark ML learner for one parameter set.

    Bagging is a forest that sees all features at every split. The network has sigmoid
    units and no weight penalty, so ``alpha`` has no effect on it.
    """
    if model == "RF":
        return RandomForestClassifier(numTrees=params["trees"], maxDepth=params["depth"], seed=seed)
    if model == "Bag":
        return RandomForestClassifier(
            numTrees=params["trees"], maxDepth=params.get("depth", MAX_DEPTH), featureSubsetStrategy="all", seed=seed
        )
    if model == "XGB":
        if classes != 2:
            raise ValueError("boosting is binary")
        return GBTClassifier(
            maxIter=params["trees"], maxDepth=params["depth"], stepSize=params["rate"], seed=seed
        )
    if model == "LogR":
        return LogisticRegression(
            regParam=1.0 / (params["c"] * max(rows, 1)), elasticNetParam=0.0, standardization=False,
            maxIter=params["iterations"],
        )
    if model == "NN":
        layers = [features, *hidden_layers(params["layout"], features), classes]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=params["iterations"], seed=seed)
    raise ValueError(f"unknown learner {model!r}")


def shared_by(model: str, params: dict, features: int) -> tuple:
    """Parameter sets for which this is equal are served by one training.

    A network depends on its layers and passes its earlier iterations on the way to later ones; boosting adds
    trees one by one. Others depend on all parameters.
    """
    if model == "NN":
        return tuple(hidden_layers(params["layout"], features))
    return tuple(sorted((k, v) for k, v in params.items() if (model, k) != ("XGB", "trees")))


def served(model: str, sets: dict[int, dict], fit: Callable[[dict], Model]) -> Iterator[tuple[list[int], Model]]:
    """Models of parameter sets that share a training, with the numbers of the sets each stands for."""
    steps = {"XGB": "trees", "NN": "iterations"}.get(model)
    values = sorted({p[steps] for p in sets.values()}) if steps else [None]
    longest = next(p for p in sets.values() if not steps or p[steps] == values[-1])
    fitted = fit(longest) if model != "NN" else None
    ended = False
    for value in values:
        numbers = [n for n, p in sets.items() if not steps or p[steps] == value]
        if model == "XGB":
            yield numbers, first_trees(fitted, value)
            continue
        if model == "NN" and not ended:
            fitted = fit(sets[numbers[0]])
            # One that stopped by itself would have stopped there with more iterations, too.
            ended = fitted.summary().totalIterations < value
        yield numbers, fitted


def first_trees(fitted: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The model that boosting had after ``count`` trees."""
    if count >= fitted.getNumTrees:
        return fitted
    jvm, gateway = fitted._java_obj, SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for i, (tree, weight) in enumerate(zip(jvm.trees(), fitted.treeWeights[:count])):
        trees[i], weights[i] = tree, weight
    own = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{fitted.uid}_{count}", trees, weights)
    return GBTClassificationModel(own)


@dataclass(frozen=True)
class CrossValidation:
    """Scores per parameter set, and the set with the best balanced accuracy."""

    scores: DataFrame
    best: dict
    model: str


def gathered(train: DataFrame, rows: int) -> DataFrame:
    """No more partitions than the rows are worth; large tables stay as they are."""
    return train.coalesce(max(-(-rows // ROWS_PER_TASK), 1))


def _params_column(params: dict):
    return F.create_map(*[F.lit(str(x)) for item in params.items() for x in item])


def cross_validate(
    prepared: Prepared,
    train: DataFrame,
    model: str,
    parameters: Sequence[dict] | None = None,
    folds: int = 5,
    seed: int = 1234,
    parallel: int = 4,
    train_scores: bool = True,
) -> CrossValidation:
    """Train every parameter set on every fold and score all of them.

    ``train`` has ``features``, ``label`` and ``fold``. Runs are submitted a few at a
    time; each gives back confusion counts, which are bounded by classes squared. Sets that
    one training serves are trained once.
    """
    parameters = list(parameters or grid(model))
    spark = train.sparkSession
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")
    ).first()
    features = len(train.select("features").first()[0])
    in_fold = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}
    train = gathered(train, sizes["rows"])

    shares = [shared_by(model, p, features) for p in parameters]
    groups = [{n: p for n, p in enumerate(parameters) if shares[n] == share} for share in dict.fromkeys(shares)]

    def run(task: tuple[dict[int, dict], int]) -> list[tuple]:
        sets, fold = task
        inside, outside = train.where(F.col("fold") != fold), train.where(F.col("fold") == fold)
        trained_on = sizes["rows"] - in_fold.get(fold, 0)
        found = []
        for numbers, fitted in served(model, sets, lambda p: estimator(model, p, features, sizes["classes"], trained_on, seed).fit(inside)):
            parts = [fitted.transform(outside).withColumn("part", F.lit("test"))]
            if train_scores:
                parts.append(fitted.transform(inside).withColumn("part", F.lit("train")))
            predicted = reduce(
                DataFrame.unionByName, [p.select("part", "label", "prediction") for p in parts]
            )
            cells = confusion(predicted, ["part"]).collect()
            found += [(n, fold, r["part"], r["label"], r["prediction"], r["n"]) for n in numbers for r in cells]
        return found

    tasks = [(sets, f) for sets in groups for f in range(folds)]
    rows = [r for found in at_once(spark, run, tasks, parallel) for r in found]
    counts = spark.createDataFrame(
        rows, "number int, fold int, part string, label double, prediction double, n bigint"
    )
    per_fold = metrics(counts, ["number", "fold", "part"])
    scores = fold_means(per_fold.where("part = 'test'"), ["number"])
    if train_scores:
        trained = fold_means(per_fold.where("part = 'train'"), ["number"], "mean_train_")
        scores = scores.join(trained, "number")
    labelled = F.lit(None).cast("map<string,string>")
    for n, p in enumerate(parameters):
        labelled = F.when(F.col("number") == n, _params_column(p)).otherwise(labelled)
    scores = scores.withColumns({"model": F.lit(model), "params": labelled})
    top = scores.orderBy(F.desc("mean_test_bal_acc"), "number").first()
    return CrossValidation(scores, parameters[top["number"]], model)


def hold_out(
    prepared: Prepared, train: DataFrame, test: DataFrame, model: str, params: dict, seed: int = 1234
) -> DataFrame:
    """Refit the best parameters on all training rows and score the test rows."""
    classes = train.select("label").distinct().count()
    features = len(train.select("features").first()[0])
    rows = train.count()
    fitted = estimator(model, params, features, classes, rows, seed).fit(gathered(train, rows))
    counts = confusion(fitted.transform(test).withColumn("model", F.lit(model)), ["model"])
    return metrics(counts, ["model"])


def evaluate_models(
    prepared: Prepared,
    ids: Sequence[str],
    models: Sequence[str],
    seed: str,
    rep: int = 0,
    size: str = "full",
    folds: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Split, cross-validate and hold out for one repetition: ``(cv_results, hold_out)``."""
    base = f"{seed}:{rep}"
    split = stratified_split(prepared.table, "label", ids, base)
    train = stratified_folds(split.where(~F.col("is_test")), "label", ids, base, folds).persist()
    test = split.where(F.col("is_test"))
    try:
        found = [cross_validate(prepared, train, m, grid(m, size), folds) for m in models]
        finals = [hold_out(prepared, train, test, cv.model, cv.best) for cv in found]
    finally:
        train.unpersist()
    results = reduce(DataFrame.unionByName, [cv.scores for cv in found]).withColumn("rep", F.lit(rep))
    return results, reduce(DataFrame.unionByName, finals).withColumn("rep", F.lit(rep))


# --- the plan of runs -----------------------------------------------------------------


def run_plan(datasets: DataFrame, repetitions: int = 5, key: str = "ds") -> DataFrame:
    """Every dataset file with every repetition."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep")
    return datasets.select(key, reps)


def open_runs(plan: DataFrame, done: DataFrame, key: str = "ds") -> DataFrame:
    """Runs of the plan without a result yet."""
    return plan.join(done.select(key, "rep").distinct(), [key, "rep"], "left_anti")
