"""From a protected table to features, a coded target, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.ranking import dense_codes, hashed_row_number
from veilspark.functions.relations import join_on_class
from veilspark.operators.equivalence import cardinalities
from veilspark.operators.schema import columns_of, integral_columns, numeric_columns

# Shares of distinct values above which text is coded as numbers, and
# integer columns carry nothing but identity.
MANY_LEVELS = 0.7
NEAR_UNIQUE = 0.9


def replace_by_code(df: DataFrame, col: str) -> DataFrame:
    """Text column replaced by the position of its value in sort order (null stays null)."""
    codes = dense_codes(df, col, "__code")
    joined = join_on_class(df, codes, [col], "left")
    return joined.select(
        *[F.col("__code").cast("double").alias(c) if c == col else F.col(c) for c in df.columns]
    )


def encode_many_levels(df: DataFrame, cols: Sequence[str], share: float = MANY_LEVELS) -> DataFrame:
    """Code the text columns with more than ``share`` distinct values per row."""
    texts = columns_of(df, "text", "other", within=cols)
    if not texts:
        return df
    stats = cardinalities(df, texts)
    for c in texts:
        if stats.rows and stats.distinct[c] / stats.rows > share:
            df = replace_by_code(df, c)
    return df


def near_unique_columns(df: DataFrame, cols: Sequence[str], share: float = NEAR_UNIQUE) -> list[str]:
    """Whole-valued columns with more than ``share`` distinct values per row."""
    whole = columns_of(df, "integer", within=cols) + integral_columns(df, cols)
    if not whole:
        return []
    stats = cardinalities(df, whole)
    return [c for c in whole if stats.rows and stats.distinct[c] / stats.rows > share]


def drop_near_unique(df: DataFrame, cols: Sequence[str], share: float = NEAR_UNIQUE) -> DataFrame:
    return df.drop(*near_unique_columns(df, cols, share))


def levels_of(df: DataFrame, col: str) -> list[str]:
    """Sorted levels of a text column."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().collect()
    return sorted(r[0] for r in found)


def one_hot_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One 0/1 column ``<col>_<level>`` per level; null has none. For levels that can name columns.

    Models take :func:`one_hot_vector`, whose schema does not grow with the levels.
    """
    added = {
        f"{c}_{level}": F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
        for c in cols
        for level in levels_of(df, c)
    }
    return df.withColumns(added).drop(*cols)


def one_hot_vector(df: DataFrame, col: str, output: str) -> DataFrame:
    """Sparse one-hot vector, for any number of levels: codes are joined, not collected.

    Null has a code behind those of the levels, which the vector leaves out: all zero.
    """
    codes = dense_codes(df.where(F.col(col).isNotNull()), col, "__code")
    size = codes.count()
    joined = join_on_class(df, codes, [col], "left")
    coded = joined.withColumn("__index", F.coalesce(F.col("__code"), F.lit(size)).cast("double"))
    if not size:
        return coded.withColumn(output, array_to_vector(F.array().cast("array<double>"))).drop("__code", "__index", col)
    # What is kept as invalid is the last category, and the last one is dropped.
    encoder = OneHotEncoder(inputCol="__index", outputCol=output, dropLast=True, handleInvalid="keep")
    return encoder.fit(coded.where(F.col("__code").isNotNull())).transform(coded).drop("__code", "__index", col)


def encode_target(df: DataFrame, target: str, name: str = "label") -> DataFrame:
    """Classes numbered from 0 in sort order."""
    codes = dense_codes(df, target, name)
    return join_on_class(df, codes, [target], "left").withColumn(name, F.col(name).cast("double"))


@dataclass(frozen=True)
class Prepared:
    """Table with ``features`` and ``label`` next to the ids."""

    table: DataFrame
    feature_names: tuple[str, ...]


def prepare(df: DataFrame, target: str, id_cols: Sequence[str]) -> Prepared:
    """Code text, drop near-unique whole numbers, one-hot the rest, number the classes."""
    cols = [c for c in df.columns if c != target and c not in id_cols]
    df = encode_many_levels(df, cols)
    df = drop_near_unique(df, cols)
    cols = [c for c in cols if c in df.columns]
    numbers = numeric_columns(df, within=cols)
    texts = [c for c in cols if c not in numbers]
    inputs = list(numbers)
    for c in texts:
        df = one_hot_vector(df, c, f"{c}_vec")
        inputs.append(f"{c}_vec")
    df = encode_target(df, target)
    assembled = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(df)
    return Prepared(assembled.select(*id_cols, "features", "label"), tuple(inputs))


def stratified_split(
    df: DataFrame, label: str, ids: Sequence[str], seed: str, test_share: float = 0.2, name: str = "is_test"
) -> DataFrame:
    """Mark ``round(test_share * n)`` rows of every class as test rows.

    Rows are drawn in the order of a seeded hash of their ids, so the split depends on
    neither partitioning nor retries, and is exact, unlike ``sampleBy``.
    """
    ranked = hashed_row_number(df, label, ids, seed, "__rn")
    marked = ranked.withColumn(
        name, F.col("__rn") <= F.round(F.lit(test_share) * F.col("__rn_of")).cast("bigint")
    )
    return marked.drop("__rn", "__rn_of")


def stratified_folds(
    df: DataFrame, label: str, ids: Sequence[str], seed: str, folds: int = 5, name: str = "fold"
) -> DataFrame:
    """Deal the rows of every class to ``folds`` folds in turn."""
    ranked = hashed_row_number(df, label, ids, seed, "__rn")
    dealt = ranked.withColumn(name, F.pmod(F.col("__rn") - 1, F.lit(folds)).cast("int"))
    return dealt.drop("__rn", "__rn_of")
