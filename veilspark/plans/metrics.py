"""Classification metrics from confusion counts, any number of models in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per key, label and prediction; combined map-side, then tiny."""
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """g-mean, accuracy, balanced accuracy, F1 of class 1 and weighted F1 per key.

    Classes are the labels that occur. The g-mean is the root of the product of the
    recalls and 0 as soon as one recall is 0. A class nobody predicts has F1 0.
    """
    labels = counts.select(*keys, F.col("label").alias("c"), "n", F.col("prediction").alias("p"))
    actual = labels.groupBy(*keys, "c").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("c") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"),
    )
    predicted = labels.groupBy(*keys, F.col("p").alias("c")).agg(F.sum("n").alias("called"))
    per_class = actual.join(predicted, [*keys, "c"], "left").select(
        *keys,
        "c",
        "support",
        "hits",
        (F.col("hits") / F.col("support")).alias("recall"),
        # 2PR / (P + R) with P = hits / called and R = hits / support.
        (2.0 * F.col("hits") / (F.col("support") + F.coalesce("called", F.lit(0)))).alias("f1"),
    )
    zero = F.count_if(F.col("recall") == 0) > 0
    logs = F.avg(F.when(F.col("recall") > 0, F.log("recall")))
    return per_class.groupBy(*keys).agg(
        F.when(zero, 0.0).otherwise(F.exp(logs)).alias("gmean"),
        (F.sum("hits") / F.sum("support")).alias("acc"),
        F.avg("recall").alias("bal_acc"),
        F.coalesce(F.max(F.when(F.col("c") == 1, F.col("f1"))), F.lit(0.0)).alias("f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def fold_means(per_fold: DataFrame, keys: Sequence[str], prefix: str = "mean_test_") -> DataFrame:
    """Mean of every metric over the folds."""
    names = ("gmean", "acc", "bal_acc", "f1", "f1_weighted")
    return per_fold.groupBy(*keys).agg(*[F.avg(m).alias(f"{prefix}{m}") for m in names])
