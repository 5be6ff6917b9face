"""Small relational helpers: null-safe joins on classes, staged tables, bounded reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def join_on_class(
    df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` in which null matches null; ``df`` keeps its column order.

    The class table has one row per key, so the join never multiplies rows. A hot key
    is skewed on the ``df`` side only, which adaptive execution can split.
    """
    renamed = table.select(
        *[F.col(k).alias(f"__class_{i}") for i, k in enumerate(keys)],
        *[F.col(c) for c in table.columns if c not in keys],
    )
    on = [df[k].eqNullSafe(renamed[f"__class_{i}"]) for i, k in enumerate(keys)]
    joined = df.join(renamed, on=on, how=how)
    return joined.drop(*[f"__class_{i}" for i in range(len(keys))])


def null_safe_equal(a: Column, b: Column) -> Column:
    """Equality in which null equals null, as a plain boolean."""
    return a.eqNullSafe(b)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    Spark takes a table's size from its compressed files and does not see that rows unfold into
    many keys; a side that it believes to be small can be more than the driver holds.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = getattr(spark, "_veilspark_folder", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="veilspark-")
        spark._veilspark_folder = folder
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of a chain of techniques; the files outlive lost executors, which
    cached or locally checkpointed blocks do not.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null for an empty denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def at_once(spark: SparkSession, work: Callable, items: Iterable, width: int = 4) -> list:
    """Run independent Spark jobs side by side, results in order.

    Jobs of a few small stages leave most of a cluster idle; submitting some of them
    together lets Spark fill it.
    """
    items = list(items)
    if len(items) < 2:
        return [work(i) for i in items]
    with ThreadPoolExecutor(min(width, len(items))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(work), i) for i in items]]
