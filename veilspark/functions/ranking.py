"""Ranks that do not send a whole group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SINGLE_TASK_LIMIT = 50_000
# Hex digits of the hash that name a slice: 65,536 slices per group.
SLICE_DIGITS = 4


def average_rank(
    value: str, partition: Sequence[str], descending: bool = False
) -> Column:
    """Rank in which tied values share the mean of their positions.

    For result tables with a bounded number of rows per partition, such as one row per
    technique combination.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    position = F.rank().over(Window.partitionBy(*partition).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return position + (ties - 1) / 2.0


def hashed_row_number(
    df: DataFrame, group: str, ids: Sequence[str], seed: str, name: str = "rn"
) -> DataFrame:
    """1-based position of every row within its group, ordered by ``md5(seed|ids)``.

    Equal to ``row_number`` over one window per group, but computed in slices: the first
    digits of the hash cut each group into equal slices, slice sizes are summed up to
    offsets, and only slices are ordered. A group holding most rows is spread evenly.
    Also returns ``<name>_of``, the size of the group.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") for i in ids]))
    keyed = df.withColumn("__h", digest).withColumn(
        "__slice", F.conv(F.substring("__h", 1, SLICE_DIGITS), 16, 10).cast("int")
    )
    sizes = keyed.groupBy(group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    # At most one row per slice of a group reaches these windows.
    upto = Window.partitionBy(group).orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        F.col(group).alias("__group"),
        F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(group)).alias("__of"),
    )
    inner = Window.partitionBy(group, "__slice").orderBy("__h", *ids)
    ranked = keyed.withColumn("__in", F.row_number().over(inner))
    joined = ranked.join(
        offsets,
        ranked[group].eqNullSafe(offsets["__group"]) & (ranked["__slice"] == offsets["__s"]),
    )
    return joined.select(
        *df.columns,
        (F.col("__before") + F.col("__in")).cast("bigint").alias(name),
        F.col("__of").cast("bigint").alias(f"{name}_of"),
    )


def dense_codes(
    df: DataFrame,
    col: str,
    code: str = "code",
    single_task_limit: int = SINGLE_TASK_LIMIT,
    buckets: int = 256,
) -> DataFrame:
    """Table ``(col, code)`` that numbers the distinct non-null values of ``col`` from 0.

    Values are numbered in their sort order. Beyond ``single_task_limit`` values they are
    cut into ranges at sampled values; each range is ordered alone and shifted by the
    sizes of the ranges before it. The cut points steer balance only, never the result.
    """
    values = df.select(F.col(col)).where(F.col(col).isNotNull()).distinct()
    few = values.limit(single_task_limit + 1).count()
    if few <= single_task_limit:
        return values.select(
            F.col(col), (F.row_number().over(Window.orderBy(col)) - 1).cast("bigint").alias(code)
        )
    cuts = _cut_points(values, col, buckets)
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(col)))
    placed = values.withColumn("__bucket", bucket)
    sizes = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    inner = Window.partitionBy("__bucket").orderBy(col)
    return (
        placed.withColumn("__rn", F.row_number().over(inner))
        .join(offsets, F.col("__bucket") == F.col("__b"))
        .select(F.col(col), (F.col("__before") + F.col("__rn") - 1).cast("bigint").alias(code))
    )


def _cut_points(values: DataFrame, col: str, buckets: int) -> list:
    """Up to ``buckets - 1`` ascending values, evenly spread over a hashed sample."""
    wanted = buckets * 32
    key = F.md5(F.col(col).cast("string"))
    sample = sorted(r[0] for r in values.orderBy(key).limit(wanted).collect())
    step = max(len(sample) // buckets, 1)
    return sorted(set(sample[step::step]))[: buckets - 1]
