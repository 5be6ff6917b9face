"""Parameter sets that share a training are scored as if each had been trained alone."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from veilspark.plans import modeling


@pytest.fixture(scope="module")
def train(spark):
    rows = spark.range(120).select(
        array_to_vector(F.array((F.col("id") * 37 % 101).cast("double"), (F.col("id") * 53 % 97).cast("double"))).alias("features"),
        ((F.col("id") * 37 % 101 + F.col("id") * 29 % 31) % 3 > 0).cast("double").alias("label"),
        (F.col("id") % 2).cast("int").alias("fold"),
    )
    return rows.coalesce(1).persist()


def scores(train, model, parameters):
    cv = modeling.cross_validate(None, train, model, parameters, folds=2)
    return sorted((r.number, *[round(r[c], 12) for c in cv.scores.columns if c.startswith("mean_")]) for r in cv.scores.collect())


def counted(monkeypatch):
    fits, make = [], modeling.estimator
    monkeypatch.setattr(modeling, "estimator", lambda m, p, *a: (fits.append(p), make(m, p, *a))[1])
    return fits


def each_alone(train, model, sets):
    return [(n, *scores(train, model, [p])[0][1:]) for n, p in enumerate(sets)]


def test_boosting_is_trained_once_for_all_numbers_of_trees(train, monkeypatch):
    sets = [{"trees": t, "depth": d, "rate": 0.5} for t in (1, 3, 6) for d in (1, 3)]
    alone = each_alone(train, "XGB", sets)
    fits = counted(monkeypatch)
    assert scores(train, "XGB", sets) == alone and len({x[1:] for x in alone}) > 3
    assert [p["trees"] for p in fits] == [6] * 4


def test_first_trees_are_those_of_a_shorter_training(train):
    long, short = (modeling.estimator("XGB", {"trees": t, "depth": 3, "rate": 0.1}, 2, 2, 120, 1).fit(train) for t in (7, 4))
    cut = modeling.first_trees(long, 4)
    assert [t.toDebugString.split("\n")[1:] for t in cut.trees] == [t.toDebugString.split("\n")[1:] for t in short.trees]
    assert cut.treeWeights == short.treeWeights
    shown = ["rawPrediction", "probability", "prediction"]
    assert cut.transform(train).select(*shown).collect() == short.transform(train).select(*shown).collect()


def test_a_network_that_stopped_stands_for_more_iterations(train, monkeypatch):
    sets = [{"layout": 1, "alpha": a, "iterations": i} for a in (1e-3, 1e-4) for i in (2, 4, 4000, 8000)]
    alone = each_alone(train, "NN", sets)
    fits = counted(monkeypatch)
    assert scores(train, "NN", sets) == alone
    # Two and four iterations are cut short, 4,000 are not.
    assert sorted(p["iterations"] for p in fits) == [2, 2, 4, 4, 4000, 4000]
