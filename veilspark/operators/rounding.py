"""Rounding to a base, and limiting decimals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.expressions import round_to_base
from veilspark.operators.policy import Policy
from veilspark.operators.schema import columns_of, numeric_columns


@dataclass(frozen=True)
class RoundingPolicy(Policy):
    """Nearest multiple of ``base``, halves to even, in the column's own type."""

    columns: tuple[str, ...] = ()
    base: float = 5.0

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        present = numeric_columns(df, within=self.columns)
        return {
            c: round_to_base(F.col(c), self.base).cast(df.schema[c].dataType) for c in present
        }


def fit_rounding(
    df: DataFrame, cols: Sequence[str] | None = None, base: float = 5.0
) -> RoundingPolicy:
    return RoundingPolicy(tuple(numeric_columns(df, within=cols)), float(base))


@dataclass(frozen=True)
class DecimalsPolicy(Policy):
    """Float columns limited to ``digits`` decimals, halves to even."""

    columns: tuple[str, ...] = ()
    digits: int = 2

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        present = columns_of(df, "float", within=self.columns)
        return {c: F.bround(F.col(c), self.digits) for c in present}


def fit_decimals(
    df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2
) -> DecimalsPolicy:
    return DecimalsPolicy(tuple(columns_of(df, "float", within=cols)), digits)
