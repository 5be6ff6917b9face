"""Global recoding: integer columns are cut into bins and take the bin's left edge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.expressions import bin_left_edge
from veilspark.operators.policy import Policy
from veilspark.operators.schema import columns_of


@dataclass(frozen=True)
class RecodingPolicy(Policy):
    """Column -> (lowest value, bin width)."""

    bins: dict[str, tuple[int, int]] = field(default_factory=dict)

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        present = columns_of(df, "integer", within=list(self.bins))
        return {
            c: bin_left_edge(F.col(c), *self.bins[c]).cast(df.schema[c].dataType)
            for c in present
            if self.bins[c][1] > 0
        }


@dataclass(frozen=True)
class IntegerStats:
    """Lowest value and population standard deviation of an integer column."""

    low: int
    high: int
    sigma: float

    def width(self, magnitude: float) -> int:
        return int(magnitude * self.sigma)


def integer_stats(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, IntegerStats]:
    """Statistics of all integer columns from one scan; all-null columns are left out."""
    chosen = columns_of(df, "integer", within=cols)
    if not chosen:
        return {}
    aggs = [
        F.struct(
            F.min(c).cast("bigint").alias("low"),
            F.max(c).cast("bigint").alias("high"),
            F.stddev_pop(c).alias("sigma"),
        ).alias(c)
        for c in chosen
    ]
    row = df.agg(*aggs).first()
    return {
        c: IntegerStats(row[c]["low"], row[c]["high"], row[c]["sigma"])
        for c in chosen
        if row[c]["low"] is not None
    }


def candidate_widths(
    stats: dict[str, IntegerStats], magnitudes: Sequence[float]
) -> dict[str, list[int]]:
    """Widths per column; a column with a zero width among them is left out."""
    widths = {c: [s.width(m) for m in magnitudes] for c, s in stats.items()}
    return {c: w for c, w in widths.items() if all(w)}


def recoding_from_widths(
    stats: dict[str, IntegerStats], widths: dict[str, int]
) -> RecodingPolicy:
    """Columns of one value or of width zero stay untouched."""
    return RecodingPolicy(
        {c: (stats[c].low, w) for c, w in widths.items() if w > 0 and stats[c].low != stats[c].high}
    )


def fit_recoding(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    magnitude: float = 1.0,
    widths: dict[str, int] | None = None,
) -> RecodingPolicy:
    """Bins ``int(magnitude * sigma)`` wide, or of the given widths."""
    stats = integer_stats(df, cols if widths is None else list(widths))
    if widths is None:
        widths = {c: s.width(magnitude) for c, s in stats.items()}
    return recoding_from_widths(stats, {c: w for c, w in widths.items() if c in stats})
