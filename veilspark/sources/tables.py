"""Readers and writers for datasets, variants and results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY_SCHEMA = "ds_id int, path string, target string"


def registry(spark: SparkSession, entries: Sequence[tuple[int, str, str | None]]) -> DataFrame:
    """``datasets(ds_id, path, target)``: one row per dataset of the collection."""
    return spark.createDataFrame(list(entries), REGISTRY_SCHEMA)


def select_datasets(datasets: DataFrame, first: int, last: int) -> DataFrame:
    """Datasets with an id in the closed range."""
    return datasets.where(F.col("ds_id").between(first, last))


def load_datasets(spark: SparkSession, datasets: DataFrame) -> dict[int, DataFrame]:
    """Open every registered dataset; schemas differ, so each stays its own table."""
    rows = datasets.orderBy("ds_id").collect()
    return {r["ds_id"]: spark.read.parquet(r["path"]) for r in rows}


def dataset_sizes(tables: dict[int, DataFrame]) -> DataFrame:
    """``(ds_id, rows)`` of the loaded datasets."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("ds_id"), "rows")
        for i, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def write_variant(df: DataFrame, root: str, ds_id: int, variant_id: int) -> None:
    """One variant under ``ds_id=/variant_id=``; schemas may differ between variants."""
    df.write.mode("overwrite").parquet(f"{root}/ds_id={ds_id}/variant_id={variant_id}")


def read_variant(spark: SparkSession, root: str, ds_id: int, variant_id: int) -> DataFrame:
    return spark.read.parquet(f"{root}/ds_id={ds_id}/variant_id={variant_id}")


def write_by_dataset(df: DataFrame, path: str) -> None:
    """Result table partitioned by dataset; only the datasets present are replaced.

    Rebalancing gathers the rows of small datasets and splits those of large ones.
    """
    (
        df.hint("rebalance", "ds_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ds_id")
        .parquet(path)
    )


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merge_batches(batches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Partial results in one table; of a row that several batches hold, the last batch's stays.

    Rows of one batch with equal keys that differ are told apart by a hash of all columns.
    """
    numbered = [b.withColumn("__batch", F.lit(i)) for i, b in enumerate(batches)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rest = [c for c in merged.columns if c not in (*keys, "__batch")]
    newest = F.max_by(F.struct(*rest), F.struct("__batch", F.xxhash64(*rest))).alias("__row")
    if not rest:
        return merged.select(*keys).distinct()
    kept = merged.groupBy(*keys).agg(newest)
    return kept.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in merged.columns if c != "__batch"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header. Without a schema the types are inferred by an extra pass."""
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), sep: str = ",") -> None:
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_tsv(df: DataFrame, path: str, partition_by: Sequence[str] = ("ds", "model")) -> None:
    write_csv(df, path, partition_by, "\t")


def path_part(name: str) -> Column:
    """Value of ``name=...`` in the path a row was read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"{name}=([^/]+)/", 1)


def read_result_folders(
    spark: SparkSession, path: str, schema: T.StructType | str, parts: Sequence[str] = ("ds", "model"), sep: str = "\t"
) -> DataFrame:
    """All result files below ``path``; dataset and learner come from the folder names.

    Files are read as a flat list, so the folders need not be a complete partitioning.
    """
    files = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("recursiveFileLookup", True)
        .schema(schema)
        .csv(path)
    )
    return files.select("*", *[path_part(p).alias(p) for p in parts])
