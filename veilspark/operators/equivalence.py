"""Equivalence classes, k-anonymity and the choice of the blocking column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from veilspark.functions.expressions import missing_if_nan
from veilspark.functions.relations import join_on_class, ratio

# countDistinct replicates a row once per column before the partial aggregation, so wide
# tables are counted in slices of columns.
COLUMNS_PER_PASS = 16


@dataclass(frozen=True)
class Cardinalities:
    rows: int
    distinct: dict[str, int]


def present(df: DataFrame, name: str) -> Column:
    """The column, with null for not-a-number."""
    real = isinstance(df.schema[name].dataType, (FloatType, DoubleType))
    return missing_if_nan(F.col(name)) if real else F.col(name)


def cardinalities(
    df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False
) -> Cardinalities:
    """Row count and distinct non-null values of every column."""
    chosen = list(df.columns if cols is None else cols)
    count = F.approx_count_distinct if approximate else F.count_distinct
    rows, distinct = 0, {}
    width = len(chosen) if approximate else COLUMNS_PER_PASS
    for start in range(0, len(chosen), max(width, 1)):
        part = chosen[start : start + width]
        found = df.agg(
            F.count(F.lit(1)).alias("__rows"), *[count(present(df, c)).alias(c) for c in part]
        ).first()
        rows = found["__rows"]
        distinct.update({c: found[c] for c in part})
    return Cardinalities(rows, distinct)


def class_counts(df: DataFrame, qi: Sequence[str], name: str = "class_size") -> DataFrame:
    """One row per equivalence class with its size."""
    return df.groupBy(*qi).agg(F.count(F.lit(1)).alias(name))


def with_class_size(df: DataFrame, qi: Sequence[str], name: str = "class_size") -> DataFrame:
    """Class size on each row.

    Counts are combined map-side and joined back, so a class that holds a third of all
    rows is never gathered in one task as a window would.
    """
    return join_on_class(df, class_counts(df.select(*qi), qi, name), qi)


def unique_share(df: DataFrame, qi: Sequence[str], name: str = "fk") -> DataFrame:
    """``fk``: percentage of rows alone in their class (null for an empty table)."""
    sizes = class_counts(df.select(*qi), qi)
    alone = F.count_if(F.col("class_size") == 1)
    return sizes.agg(ratio(100 * alone, F.sum("class_size")).alias(name))


def anonymity(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """``k``, ``fk``, number of classes and of rows from the same aggregate."""
    sizes = class_counts(df.select(*qi), qi)
    return sizes.agg(
        F.min("class_size").alias("k"),
        ratio(100 * F.count_if(F.col("class_size") == 1), F.sum("class_size")).alias("fk"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("class_size").alias("rows"),
    )


def class_histogram(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """How many classes, and rows in them, there are of each size."""
    sizes = class_counts(df.select(*qi), qi)
    return sizes.groupBy("class_size").agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("class_size").alias("rows"),
    )


def fk_value(df: DataFrame, qi: Sequence[str]) -> float | None:
    return unique_share(df, qi).first()[0]


# Fixed value: a column with this share of distinct values or more makes no good block.
NEAR_UNIQUE = 0.85


def pick_block(stats: Cardinalities, near_unique: float = NEAR_UNIQUE) -> str:
    """Blocking column from cardinalities; ties go to the first column in schema order.

    The largest cardinality wins, unless it is near-unique: then the largest one below
    that mark, or the smallest if none is below.
    """
    values = sorted(set(stats.distinct.values()))
    wanted = values[-1]
    if wanted >= near_unique * stats.rows and len(values) > 1:
        below = [v for v in values if v < near_unique * stats.rows]
        wanted = below[-1] if below else values[0]
    return next(c for c, v in stats.distinct.items() if v == wanted)


def choose_block(
    df: DataFrame, qi: Sequence[str], approximate: bool = False
) -> tuple[str, Cardinalities]:
    """Blocking column of ``df`` and the cardinalities it was chosen from."""
    stats = cardinalities(df, qi, approximate)
    return pick_block(stats), stats
