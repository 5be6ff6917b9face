"""Column classes, integral narrowing, type alignment and technique eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)

# The order in which techniques are applied.
TECHNIQUES = ("sup", "topbot", "noise", "round", "globalrec")

# Which techniques a column class makes possible.
ELIGIBLE = {
    "text": ("sup",),
    "integer": ("sup", "topbot", "globalrec", "round"),
    "float": ("topbot", "round", "noise", "sup"),
    "other": ("sup",),
}

BIGINT_EDGE = float(2**63)


def column_class(data_type: T.DataType) -> str:
    """``integer``, ``float``, ``text`` or ``other``."""
    if isinstance(data_type, INTEGER_TYPES):
        return "integer"
    if isinstance(data_type, FLOAT_TYPES):
        return "float"
    if isinstance(data_type, TEXT_TYPES):
        return "text"
    return "other"


def columns_of(df: DataFrame, *classes: str, within: Sequence[str] | None = None) -> list[str]:
    """Columns of the given classes, in schema order."""
    return [
        f.name
        for f in df.schema
        if column_class(f.dataType) in classes and (within is None or f.name in within)
    ]


def numeric_columns(df: DataFrame, within: Sequence[str] | None = None) -> list[str]:
    return columns_of(df, "integer", "float", within=within)


def quasi_identifiers(
    df: DataFrame,
    qi: Sequence[str] | None = None,
    target: str | None = None,
    id_cols: Sequence[str] = (),
) -> list[str]:
    """Columns under study: the given ones, or all but the ids and the target."""
    if qi is not None:
        return list(qi)
    return [c for c in df.columns if c != target and c not in id_cols]


def integral_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Float columns in which no value has a fractional part, found in one scan.

    Columns that hold a null or a value outside the 64-bit range stay float.
    """
    floats = columns_of(df, "float", within=cols)
    if not floats:
        return []
    tests = [
        F.bool_and(
            F.coalesce(
                (F.col(c) == F.floor(F.col(c).cast("double")))
                & (F.abs(F.col(c).cast("double")) < F.lit(BIGINT_EDGE)),
                F.lit(False),
            )
        ).alias(c)
        for c in floats
    ]
    found = df.agg(*tests).first()
    return [c for c in floats if found[c]]


def narrow_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Whole-valued float columns become ``BIGINT``, decimals become ``DOUBLE``."""
    whole = set(integral_columns(df, cols))
    casts = {c: F.col(c).cast("bigint") for c in whole}
    for f in df.schema:
        chosen = cols is None or f.name in cols
        if chosen and f.name not in whole and isinstance(f.dataType, T.DecimalType):
            casts[f.name] = F.col(f.name).cast("double")
    return df.withColumns(casts) if casts else df


def align_types(original: DataFrame, protected: DataFrame) -> DataFrame:
    """Cast the original's columns to the types the protected table has.

    A suppressed column is text, so its original is compared as text as well.
    """
    if original.columns != protected.columns:
        raise ValueError("both tables need the same columns in the same order")
    return original.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in protected.schema]
    )


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The table without its target, and the target alone."""
    return df.drop(target), df.select(target)


def eligible_techniques(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Techniques that fit at least one column, in the order they are applied."""
    chosen = df.columns if cols is None else list(cols)
    fitting = {
        t
        for f in df.schema
        if f.name in chosen
        for t in ELIGIBLE[column_class(f.dataType)]
    }
    return [t for t in TECHNIQUES if t in fitting]


def technique_combinations(techniques: Sequence[str]) -> list[tuple[str, ...]]:
    """Every non-empty combination, smallest first (31 for all five techniques)."""
    return [c for size in range(1, len(techniques) + 1) for c in combinations(techniques, size)]


def combinations_frame(
    spark: SparkSession, combos: Sequence[Sequence[str]], ds_id: int = 0
) -> DataFrame:
    """``combos(ds_id, variant_id, techniques)``; at most 31 rows."""
    rows = [(ds_id, i, list(c)) for i, c in enumerate(combos)]
    return spark.createDataFrame(
        rows, "ds_id int, variant_id int, techniques array<string>"
    )


def prune_combinations(combos: DataFrame, unchanged: Sequence[str]) -> DataFrame:
    """Drop every combination that contains a technique which changed nothing."""
    if not unchanged:
        return combos
    dead = F.array(*[F.lit(t) for t in unchanged])
    return combos.where(~F.arrays_overlap("techniques", dead))
