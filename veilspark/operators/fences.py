"""Top and bottom coding with Tukey fences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.expressions import missing_if_nan
from veilspark.functions.quantiles import quantiles
from veilspark.operators.policy import Policy
from veilspark.operators.schema import column_class, numeric_columns


@dataclass(frozen=True)
class FencePolicy(Policy):
    """Lower and upper fence per column; values on or beyond a fence take its value."""

    fences: dict[str, tuple[float, float]] = field(default_factory=dict)

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for name, (low, high) in self.fences.items():
            data_type = df.schema[name].dataType
            if column_class(data_type) not in ("integer", "float") or low == high:
                continue
            value = F.col(name) if column_class(data_type) == "integer" else missing_if_nan(F.col(name))
            # A cast to an integer type truncates toward zero, as wanted for the fence.
            out[name] = (
                F.when(value <= F.lit(low), F.lit(low).cast(data_type))
                .when(value >= F.lit(high), F.lit(high).cast(data_type))
                .otherwise(F.col(name))
            )
        return out

    def outlier(self, name: str) -> Column:
        """Row flag: the value lies on or beyond a fence."""
        low, high = self.fences[name]
        if low == high:
            return F.lit(False)
        value = missing_if_nan(F.col(name).cast("double"))
        beyond = (value <= F.lit(low)) | (value >= F.lit(high))
        return F.coalesce(beyond, F.lit(False))


def quartiles(
    df: DataFrame, cols: Sequence[str], approximate: bool = False, accuracy: int = 10_000
) -> dict[str, tuple[float, float]]:
    """First and third quartile of all columns at once."""
    if not cols:
        return {}
    if approximate:
        probs = F.array(F.lit(0.25), F.lit(0.75))
        row = df.agg(
            *[F.percentile_approx(missing_if_nan(F.col(c).cast("double")), probs, F.lit(accuracy)).alias(c) for c in cols]
        ).first()
    else:
        row = quantiles(df, cols, (0.25, 0.75)).first()
    return {c: (row[c][0], row[c][1]) for c in cols if row and row[c] is not None}


def fences_from_quartiles(
    found: dict[str, tuple[float, float]], factor: float
) -> FencePolicy:
    return FencePolicy(
        {
            c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
            for c, (q1, q3) in found.items()
        }
    )


def fit_fences(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    factor: float = 1.5,
    approximate: bool = False,
) -> FencePolicy:
    """Fences ``factor`` interquartile ranges outside the quartiles."""
    chosen = numeric_columns(df, within=cols)
    return fences_from_quartiles(quartiles(df, chosen, approximate), factor)


def outlier_counts(df: DataFrame, policy: FencePolicy) -> DataFrame:
    """One row per column: fences and the number of values on or beyond them."""
    names = list(policy.fences)
    flags = df.select(*[policy.outlier(c).cast("bigint").alias(c) for c in names])
    totals = flags.agg(*[F.sum(c).alias(c) for c in names])
    return totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(policy.fences[c][0]).alias("lower"),
                        F.lit(policy.fences[c][1]).alias("upper"),
                        F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("outliers"),
                    )
                    for c in names
                ]
            )
        ).alias("x")
    ).select("x.*")
