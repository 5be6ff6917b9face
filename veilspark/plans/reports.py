"""Reports over the result tables: risk, combinations and cross-validation results.

``risk(ds_id, variant_id, comb, initial_fk, fk, rl)``, ``combos(ds_id, variant_id,
solution, techniques)`` and ``perf(ds_id, ds, model, solution, rep, mean_test_*)`` are
ordinary tables that grow with the number of datasets, learners and repetitions. What is
bounded is the number of combinations (31), which is why reports may pivot and rank
over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.expressions import (
    INITIALS,
    absolute_percentage_difference,
    compact_solution,
    display_model,
    hash_uniform,
    missing_if_nan,
    percentage_difference,
    poisson_one,
)
from veilspark.functions.quantiles import quantiles
from veilspark.functions.ranking import average_rank

# Labels of the two groups of datasets.
ALL_DATASETS = "All datasets"
COMPLETE_DATASETS = "18 datasets"
COMPARISONS = (COMPLETE_DATASETS, ALL_DATASETS)

# Compared metrics.
METRICS = ("gmean", "acc", "bal_acc", "f1", "f1_weighted")


def solution_names(separator: str = ", ") -> list[str]:
    """All 31 combinations of the five initials, shortest first, then alphabetical."""
    letters = sorted(INITIALS.values())
    return [separator.join(c) for size in range(1, len(letters) + 1) for c in combinations(letters, size)]


# --- combinations ---------------------------------------------------------------------


def variants_per_dataset(combos: DataFrame) -> DataFrame:
    return combos.groupBy("ds_id").agg(F.count_distinct("variant_id").alias("variants"))


def complete_datasets(combos: DataFrame, expected: int = 31) -> DataFrame:
    """Datasets for which every combination exists."""
    return variants_per_dataset(combos).where(F.col("variants") == expected).select("ds_id")


def variant_totals(combos: DataFrame, expected: int = 31) -> DataFrame:
    """Number of variants, of combinations and of complete datasets."""
    per_dataset = combos.groupBy("ds_id").agg(
        F.count_distinct("variant_id").alias("variants"), F.count_distinct("solution").alias("solutions")
    )
    return per_dataset.agg(
        F.sum("variants").alias("variants"),
        F.sum("solutions").alias("combinations"),
        F.count_if(F.col("variants") == expected).alias("complete"),
    )


def venn_regions(combos: DataFrame) -> DataFrame:
    """Number of datasets per exact set of techniques."""
    key = F.array_join(F.array_sort("techniques"), ", ")
    return combos.groupBy(key.alias("region")).agg(F.count_distinct("ds_id").alias("datasets"))


def technique_totals(combos: DataFrame) -> DataFrame:
    """Variants and datasets each technique takes part in."""
    members = combos.select("ds_id", "variant_id", F.explode("techniques").alias("technique"))
    return members.groupBy("technique").agg(
        F.count(F.lit(1)).alias("variants"), F.count_distinct("ds_id").alias("datasets")
    )


def with_comparison(df: DataFrame, complete: DataFrame) -> DataFrame:
    """Every row once for all datasets, and once more if its dataset is complete.

    One scan with a repeated row instead of a union of two scans.
    """
    marked = df.join(complete.select(F.col("ds_id"), F.lit(True).alias("__full")), "ds_id", "left")
    labels = F.when(F.col("__full"), F.array(F.lit(ALL_DATASETS), F.lit(COMPLETE_DATASETS))).otherwise(
        F.array(F.lit(ALL_DATASETS))
    )
    return marked.withColumn("comparison", F.explode(labels)).drop("__full")


# --- risk -----------------------------------------------------------------------------


def risk_differences(risk: DataFrame) -> DataFrame:
    diff = absolute_percentage_difference(F.col("rl"), F.col("initial_fk"))
    return risk.withColumn("diff", diff)


def risk_pivot(risk: DataFrame) -> DataFrame:
    """Whole-percent risk difference per dataset (rows) and combination (columns).

    The combination list is fixed, so absent ones become null columns and no extra job
    looks for the values; columns come shortest name first.
    """
    cells = risk_differences(risk).select("ds_id", "comb", F.col("diff").cast("int").alias("diff"))
    return cells.groupBy("ds_id").pivot("comb", solution_names()).agg(F.first("diff", ignorenulls=True))


def original_pivot(risk: DataFrame) -> DataFrame:
    """Risk of the untouched datasets as one column ``O``."""
    rows = risk.groupBy("ds_id").agg(F.max("initial_fk").alias("initial_fk"))
    labelled = rows.withColumn("comb", F.lit("O"))
    return labelled.groupBy("ds_id").pivot("comb", ["O"]).agg(
        F.first(F.col("initial_fk").cast("int"))
    )


def risk_means(risk: DataFrame, complete: DataFrame) -> DataFrame:
    """Mean ``rl`` and its rank per combination within each group of datasets."""
    means = with_comparison(risk, complete).groupBy("comb", "comparison").agg(F.avg("rl").alias("rl"))
    # Sums of the same numbers differ in the last digits by order; ties must not.
    means = means.withColumn("rl", F.round("rl", 9))
    return means.withColumn("rank", average_rank("rl", ["comparison"]).cast("int"))


def summary(df: DataFrame, col: str) -> DataFrame:
    """``statistic, value`` rows as a table summary gives them, with exact quartiles; NaN is missing."""
    df = df.select(missing_if_nan(F.col(col).cast("double")).alias(col))
    moments = df.agg(
        F.count(col).cast("double").alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        F.max(col).cast("double").alias("max"),
    )
    cuts = quantiles(df, [col], (0.25, 0.5, 0.75)).select(
        *[F.col(col)[i].alias(n) for i, n in enumerate(("25%", "50%", "75%"))]
    )
    long = [
        t.unpivot([], t.columns, "statistic", "value") for t in (moments, cuts)
    ]
    return long[0].unionByName(long[1])


def in_solution_order(df: DataFrame, col: str, name: str = "ord") -> DataFrame:
    """Number the combinations that occur by (length, lower case, name); null stays null.

    The distinct names are few and ranked apart; rows are joined to their ranks.
    """
    names = df.select(F.col(col).alias("__name")).where(F.col(col).isNotNull()).distinct()
    order = Window.orderBy(F.length("__name"), F.lower("__name"), "__name")
    ranks = names.withColumn(name, F.row_number().over(order))
    joined = df.drop(name).join(ranks, F.col(col) == F.col("__name"), "left")
    return joined.drop("__name")


def rank_pivot(means: DataFrame, row: str, column: str, values: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Table of ranks: one row per ``row``, one column per given value of ``column``."""
    return means.groupBy(*extra, row).pivot(column, list(values)).agg(F.avg("rank"))


def bar_means(risk: DataFrame, complete: DataFrame, value: str = "diff") -> DataFrame:
    """Mean, deviation and a normal 95 % interval per combination and group."""
    rows = with_comparison(risk_differences(risk), complete).where(F.col(value).isNotNull())
    stats = rows.groupBy("comb", "comparison").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    half = 1.959963984540054 * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return stats.select(
        "comb", "comparison", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high")
    )


def bootstrap_means(
    risk: DataFrame, complete: DataFrame, ids: Sequence[str], seed: str, replicates: int = 100
) -> DataFrame:
    """Mean of every bootstrap replicate per combination and group.

    Replicate weights are Poisson(1) draws keyed by row and replicate. The repeated rows
    are summed map-side, so groups times replicates reach the shuffle. Take quantiles of
    ``mean`` over the replicates for an interval.
    """
    rows = with_comparison(risk_differences(risk), complete).where(F.col("diff").isNotNull())
    repeated = rows.select(
        "comb", "comparison", "diff", *[F.col(i) for i in ids if i not in ("comb", "comparison")],
        F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"),
    )
    weight = poisson_one(hash_uniform(seed, F.col("replicate"), F.col("comparison"), *[F.col(i) for i in ids]))
    weighted = repeated.withColumn("w", weight)
    return weighted.groupBy("comb", "comparison", "replicate").agg(
        F.try_divide(F.sum(F.col("w") * F.col("diff")), F.sum("w").cast("double")).alias("mean")
    )


# --- risk against performance ---------------------------------------------------------


def zero_risk(risk: DataFrame, complete: DataFrame) -> DataFrame:
    """Variants of complete datasets that no record can be linked from."""
    full = risk.join(complete, "ds_id", "left_semi")
    return full.where(F.col("rl") == 0).select("ds_id", "comb", "rl")


def best_rows(df: DataFrame, groups: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """Row with the largest ``value`` per group; ties go to the smallest tie key.

    A maximum of structs combines map-side, so one large group costs one struct per task;
    a window would sort the whole group in a single task.
    """
    rest = [c for c in df.columns if c not in groups and c != value and c not in ties]
    first = F.min_by(
        F.struct(*[F.col(c) for c in (value, *ties, *rest)]),
        F.struct((-F.col(value)).alias("v"), *[F.col(t) for t in ties]),
    )
    return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(first.alias("r")).select(*groups, "r.*")


def at_group_maximum(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """All rows that reach the maximum of their group (draws stay)."""
    top = df.groupBy(*groups).agg(F.max(value).alias("__top"))
    joined = df.join(top, list(groups))
    return joined.where(F.col(value) == F.col("__top")).drop("__top").select(*df.columns)


def best_private_performance(
    perf: DataFrame, risk: DataFrame, complete: DataFrame, value: str, ties: Sequence[str]
) -> DataFrame:
    """Best result per learner and dataset among the variants without linkage risk."""
    safe = zero_risk(risk, complete).select("ds_id", F.col("comb").alias("solution"))
    joined = perf.join(safe, ["ds_id", "solution"])
    slim = joined.select("model", "ds_id", "solution", value, *ties)
    best = best_rows(slim, ["model", "ds_id", "solution"], value, ties)
    return best.withColumn("model", display_model(F.col("model")))


# --- performance ----------------------------------------------------------------------


def baselines(originals: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Best score of the untouched dataset per learner and metric."""
    present = [m for m in metrics if f"mean_test_{m}" in originals.columns]
    return originals.groupBy("ds_id", "model").agg(
        *[F.max(f"mean_test_{m}").alias(f"base_{m}") for m in present]
    )


def performance_differences(
    perf: DataFrame, originals: DataFrame, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Percentage difference to the baseline of the same dataset and learner."""
    present = [
        m for m in metrics if f"mean_test_{m}" in perf.columns and f"mean_test_{m}" in originals.columns
    ]
    joined = perf.join(baselines(originals, present), ["ds_id", "model"])
    added = {
        f"mean_test_{m}_perdif": percentage_difference(F.col(f"mean_test_{m}"), F.col(f"base_{m}"))
        for m in present
    }
    return joined.withColumns(added).drop(*[f"base_{m}" for m in present])


def by_solution(perf: DataFrame, combos: DataFrame) -> DataFrame:
    """Results with the combination that made their variant, found by key."""
    named = combos.select("ds_id", "variant_id", "solution")
    joined = perf.drop("solution").join(named, ["ds_id", "variant_id"])
    return joined.withColumn("solution", compact_solution(F.col("solution")))


def melt_metrics(perf: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return perf.select(*ids, *columns).unpivot(list(ids), list(columns), "metrics", "values")


def box_statistics(
    df: DataFrame, groups: Sequence[str], value: str, reach: float = 1.5, method: str = "auto"
) -> DataFrame:
    """Quartiles, whiskers and outliers per group: what a box plot draws."""
    rows = df.select(*groups, missing_if_nan(F.col(value).cast("double")).alias("v")).where(F.col("v").isNotNull())
    q = quantiles(rows, ["v"], (0.25, 0.5, 0.75), groups, method).select(
        *groups, *[F.col("v")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    spread = reach * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - spread) & (F.col("v") <= F.col("q3") + spread)
    return (
        rows.join(q, list(groups))
        .groupBy(*groups, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def performance_ranks(
    perf: DataFrame, complete: DataFrame, value: str, best_first: bool = False
) -> DataFrame:
    """Mean result and its descending rank per learner, combination and group.

    ``best_first`` averages the best result of each dataset instead of all results.
    """
    rows = with_comparison(perf, complete)
    if best_first:
        rows = rows.groupBy("ds_id", "model", "solution", "comparison").agg(F.max(value).alias(value))
    means = rows.groupBy("model", "solution", "comparison").agg(F.round(F.avg(value), 9).alias(value))
    ranked = means.withColumn("rank", average_rank(value, ["model", "comparison"], True).cast("int"))
    return ranked.withColumn("model", display_model(F.col("model")))


def repetitions_of(perf: DataFrame, reps: Sequence[int]) -> DataFrame:
    """Results of the given repetitions in one table (they are not averaged)."""
    return perf.where(F.col("rep").isin(*reps))


def is_original(name: Column) -> Column:
    """Results of an untouched dataset carry no ``_`` in their name."""
    return ~F.contains(name, F.lit("_"))
