"""Common shape of a fitted technique."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Parameters of one technique; ``transform`` is a plain projection.

    Because nothing but literals is needed, the same policy runs on a static table and
    on a stream.
    """

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        changes = self.expressions(df)
        return df.withColumns(changes) if changes else df

    def changes_nothing(self, df: DataFrame) -> bool:
        """True if every value stays as it is, decided in one scan without a join."""
        changes = self.expressions(df)
        if not changes:
            return True
        differs = F.lit(False)
        for name, value in changes.items():
            before = F.col(name).cast("string") if self.retypes(name) else F.col(name)
            differs = differs | ~value.eqNullSafe(before)
        return not df.agg(F.coalesce(F.bool_or(differs), F.lit(False))).first()[0]

    def retypes(self, name: str) -> bool:
        """Whether the technique turns this column into text."""
        return False
