"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import veilspark
from veilspark.functions.relations import new_path, shared_folder

BROADCAST_BYTES = 32 << 20
"""A side is only broadcast if its counted bytes are fewer."""


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, outlives executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of kept tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "_kept_at", None)
        if path is not None:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            table._kept_at = None


def folder_uri(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, as a URI that tasks can open."""
    shared_folder(spark)
    path = new_path(spark, label)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcasting if its counted rows are few enough, else leave the choice to Spark.

    Counts the rows, so ``df`` should be a kept table. ``row_bytes`` bounds the bytes of a row.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a text; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def parts_for(rows: int, each: int) -> int:
    """Number of parts so that each holds about ``each`` rows."""
    return max(1, math.ceil(rows / each))


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per session, the way ``--py-files`` would.

    Python workers of a cluster do not see the driver's import path.
    """
    context = spark.sparkContext
    if getattr(context, "_veilspark_sent", None) is None:
        root = Path(veilspark.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="veilspark-code-")) / "veilspark_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._veilspark_sent = str(archive)


def whole_texts_in_small_batches(spark: SparkSession) -> None:
    """Send workers fewer rows at once than Spark's default, which is meant for rows of numbers.

    A batch of 10,000 texts is held several times over by a worker. Settings of the caller's own stay.
    """
    for name, default, small in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, "8m")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.sparkContext.getConf().get(name) is None and spark.conf.get(name, default) != small:
            spark.conf.set(name, small)


_held: dict[str, Any] = {}
_operator = ""


def held_in_worker(name: str, build: Callable[[], Any]) -> Any:
    """What a Python worker holds from one task of an operator to the next, built once."""
    if name not in _held:
        _held.clear()
        _held[name] = build()
    return _held[name]


def take_over(operator: str) -> None:
    """Give back what the worker held for another operator.

    Spark reuses workers, so tables of one operator would stand beside those of the next in an executor's memory.
    """
    global _operator
    if operator != _operator:
        _operator = operator
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc
            ctypes.CDLL(None).malloc_trim(0)


def in_tasks(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(function, schema)`` with this package at hand; the function's module names the operator."""
    ship_code(df.sparkSession)
    whole_texts_in_small_batches(df.sparkSession)
    operator = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(operator)
        return function(batches)

    return df.mapInArrow(run, schema)
