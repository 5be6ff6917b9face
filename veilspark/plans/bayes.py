"""Bayesian sign test with a region of practical equivalence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.expressions import compact_solution, percentage_difference

# Prior weight, region of practical equivalence, plotted share, draws.
PRIOR = 0.0001
ROPE = (-1.0, 1.0)
VISIBLE = 0.0099
DRAWS = 30_000

DRAWS_PER_CHUNK = 1_000
OUTCOMES = ("Lose", "Draw", "Win")


def proportions(
    df: DataFrame, value: str, group: str = "solution", rope: tuple[float, float] = ROPE
) -> DataFrame:
    """Share of differences left of, inside and right of the region, per group.

    The bounds are strict: a difference on a bound belongs to none of the three.
    """
    low, high = rope
    v = F.col(value)
    return (
        df.where(v.isNotNull())
        .groupBy(group)
        .agg(
            F.avg((v < low).cast("double")).alias("left"),
            F.avg(((v > low) & (v < high)).cast("double")).alias("inside"),
            F.avg((v > high).cast("double")).alias("right"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def sign_test(
    df: DataFrame,
    value: str,
    group: str = "solution",
    rope: tuple[float, float] = ROPE,
    prior: float = PRIOR,
    counts: bool = False,
) -> DataFrame:
    """Posterior mean probabilities ``lose``, ``draw``, ``win`` per group.

    The mean of a Dirichlet is known exactly, so no draws are needed. ``counts=True``
    weighs by the number of differences instead of their share.
    """
    alpha = _alphas(df, value, group, rope, prior, counts)
    total = F.col("a_lose") + F.col("a_draw") + F.col("a_win")
    return alpha.select(
        group, *[(F.col(f"a_{o}") / total).alias(o) for o in ("lose", "draw", "win")]
    )


def _alphas(df, value, group, rope, prior, counts) -> DataFrame:
    weight = F.col("n").cast("double") if counts else F.lit(1.0)
    return proportions(df, value, group, rope).select(
        group,
        *[
            (F.col(c) * weight + prior).alias(f"a_{o}")
            for c, o in (("left", "lose"), ("inside", "draw"), ("right", "win"))
        ],
    )


def sign_test_draws(
    df: DataFrame,
    value: str,
    group: str = "solution",
    rope: tuple[float, float] = ROPE,
    prior: float = PRIOR,
    draws: int = DRAWS,
    seed: int = 1234,
) -> DataFrame:
    """The same probabilities as means of Dirichlet draws.

    Draws are made in chunks that Spark spreads over the tasks. A chunk seeds its own
    generator from its group and number, so a task run again gives the same draws.
    """
    chunks = max(draws // DRAWS_PER_CHUNK, 1)
    alpha = _alphas(df, value, group, rope, prior, False)
    work = alpha.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    work = work.withColumn("key", F.xxhash64(F.lit(seed), F.col(group), F.col("chunk")))
    work = work.repartition("key")
    size = -(-draws // chunks)
    schema = T.StructType(
        [work.schema[group]] + [T.StructField(o, T.DoubleType()) for o in ("lose", "draw", "win")]
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                rng = np.random.default_rng(row.key & 0x7FFFFFFFFFFFFFFF)
                mean = rng.dirichlet([row.a_lose, row.a_draw, row.a_win], size).mean(axis=0)
                rows.append((getattr(row, group), *mean))
            yield pd.DataFrame(rows, columns=[group, "lose", "draw", "win"])

    means = work.mapInPandas(draw, schema)
    return means.groupBy(group).agg(*[F.avg(o).alias(o) for o in ("lose", "draw", "win")])


def as_long(tested: DataFrame, group: str = "solution") -> DataFrame:
    """``(solution, result, probability)`` with one row per outcome."""
    renamed = tested.select(group, *[F.col(o.lower()).alias(o) for o in OUTCOMES])
    return renamed.unpivot([group], list(OUTCOMES), "result", "probability")


def visible(long: DataFrame, least: float = VISIBLE) -> DataFrame:
    """Outcomes likely enough to be shown."""
    return long.where(F.col("probability") > least)


def outcome_totals(long: DataFrame, group: str = "solution") -> DataFrame:
    """Stacked total per combination and outcome."""
    return long.groupBy(group, "result").agg(F.sum("probability").alias("total"))


def distinct_outcomes(long: DataFrame) -> DataFrame:
    return long.agg(F.count_distinct("result").alias("outcomes"))


def best_per_solution(perf: DataFrame, value: str, by: tuple[str, ...] = ("ds_id", "solution")) -> DataFrame:
    return perf.groupBy(*by).agg(F.max(value).alias(value))


def against_best_solution(perf: DataFrame, score: str, name: str) -> DataFrame:
    """Percentage difference of every result to the best one of its dataset and learner."""
    top = perf.groupBy("ds_id", "model").agg(F.max(score).alias("__best"))
    joined = perf.join(top, ["ds_id", "model"])
    return joined.withColumn(name, percentage_difference(F.col(score), F.col("__best"))).drop("__best")


def against_best_private(perf: DataFrame, risk: DataFrame, score: str, name: str) -> DataFrame:
    """As above, with the best result among the variants of least linkage risk."""
    least = risk.groupBy("ds_id").agg(F.min("rl").alias("__least"))
    private = (
        risk.join(least, "ds_id")
        .where(F.col("rl") == F.col("__least"))
        .select("ds_id", F.col("comb").alias("solution"))
        .distinct()
    )
    top = (
        perf.join(private, ["ds_id", "solution"])
        .groupBy("ds_id", "model")
        .agg(F.max(score).alias("__best"))
    )
    joined = perf.join(top, ["ds_id", "model"])
    return joined.withColumn(name, percentage_difference(F.col(score), F.col("__best"))).drop("__best")


def test_solutions(perf: DataFrame, value: str, source: str | None = None) -> DataFrame:
    """Best difference per dataset and combination, tested per combination, long form."""
    best = best_per_solution(perf, value)
    named = best.withColumn("solution", compact_solution(F.col("solution")))
    long = as_long(sign_test(named, value))
    return long if source is None else long.withColumn("source", F.lit(source))
