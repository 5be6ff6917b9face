"""Table access, shared views and the decorator that registers a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round doubles before they are compared; sums differ in the last digits by order."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


# The views below read the same in Spark SQL and in DuckDB.
PERF = """
WITH v AS (
  SELECT CAST(l_suppkey % 20 AS INT) AS ds_id, CAST((l_partkey * 7 + l_orderkey) % 31 + 1 AS INT) AS any_id, *
  FROM {lineitem}),
b AS (
  SELECT ds_id, CASE WHEN ds_id % 3 = 0 AND any_id >= 30 THEN any_id - 29 ELSE any_id END AS variant_id,
    l_linenumber % 5 AS m, CAST(l_orderkey % 5 AS INT) AS rep,
    l_quantity AS q, l_discount AS d, l_tax AS t, l_orderkey, l_linenumber
  FROM v)
SELECT l_orderkey, l_linenumber, ds_id, variant_id, rep,
  concat('ds', CAST(ds_id AS VARCHAR(9)), '_transf', CAST(variant_id AS VARCHAR(9))) AS ds,
  CASE m WHEN 0 THEN 'RF' WHEN 1 THEN 'Bag' WHEN 2 THEN 'XGB' WHEN 3 THEN 'LogR' ELSE 'NN' END AS model,
  concat_ws(', ', CASE WHEN (variant_id & 1) > 0 THEN 'G' END,
    CASE WHEN (variant_id & 2) > 0 THEN 'N' END, CASE WHEN (variant_id & 4) > 0 THEN 'R' END,
    CASE WHEN (variant_id & 8) > 0 THEN 'S' END, CASE WHEN (variant_id & 16) > 0 THEN 'T' END) AS solution,
  round(0.5e0 + d + t, 6) AS mean_test_gmean,
  round(0.4e0 + q / 100e0 + t, 6) AS mean_test_bal_acc,
  round(0.4e0 + q / 100e0 + d, 6) AS mean_test_f1_weighted
FROM b
"""

PERF_BASE = """
SELECT o_orderkey, CAST(o_custkey % 20 AS INT) AS ds_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'RF' WHEN 1 THEN 'Bag' WHEN 2 THEN 'XGB' WHEN 3 THEN 'LogR' ELSE 'NN' END AS model,
  round(0.5e0 + (o_orderkey % 400) / 1000e0, 6) AS mean_test_f1_weighted
FROM {orders}
"""

RISK = """
SELECT ds_id, variant_id, solution AS comb, CAST(10 + ds_id * 4 AS DOUBLE) AS initial_fk,
  CAST(sum(l_linenumber) % 90 AS DOUBLE) AS fk, CAST(sum(l_orderkey) % 50 * 2 AS DOUBLE) AS rl
FROM {perf_v} GROUP BY ds_id, variant_id, solution
"""

COMBOS = "SELECT DISTINCT ds_id, variant_id, solution FROM {perf_v}"

# The same views as common table expressions for DuckDB.
DUCK_VIEWS = (
    f"perf_v AS ({PERF.format(lineitem='lineitem')}), "
    f"perf_base_v AS ({PERF_BASE.format(orders='orders')}), "
    f"risk_v AS ({RISK.format(perf_v='perf_v')}), "
    f"combos_v AS ({COMBOS.format(perf_v='perf_v')})"
)

# Datasets with all 31 variants, and rows doubled for them.
DUCK_COMPLETE = (
    "full_v AS (SELECT ds_id FROM combos_v GROUP BY ds_id HAVING count(DISTINCT variant_id) = 31)"
)


def duck_compared(name: str, source: str) -> str:
    """Rows of ``source`` labelled for all and for complete datasets."""
    return (
        f"{name} AS (SELECT *, 'All datasets' AS comparison FROM {source} "
        f"UNION ALL SELECT *, '18 datasets' AS comparison FROM {source} "
        "WHERE ds_id IN (SELECT ds_id FROM full_v))"
    )


def perf_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PERF, lineitem=table(spark, sf_dir, "lineitem"))


def perf_base_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PERF_BASE, orders=table(spark, sf_dir, "orders"))


def risk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RISK, perf_v=perf_view(spark, sf_dir))


def combos_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    combos = spark.sql(COMBOS, perf_v=perf_view(spark, sf_dir))
    return combos.withColumn("techniques", F.split("solution", ", "))
