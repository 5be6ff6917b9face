"""Queries that pass through a source, a sink or a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog import duck
from veilspark.catalog.analysis import F1, WITH
from veilspark.catalog.base import combos_view, perf_view, query, risk_view, rounded, table
from veilspark.functions.relations import new_path
from veilspark.operators.fences import fit_fences
from veilspark.operators.rounding import fit_rounding
from veilspark.operators.suppression import fit_suppression
from veilspark.sources import tables
from veilspark.streaming.policies import protect_stream, run_available

_COLLECTION = ("part", "customer", "orders", "lineitem", "events", "documents")


@query(
    "datasets_by_id",
    " UNION ALL ".join(
        f"SELECT {i} AS ds_id, count(*)::BIGINT AS rows FROM {t}" for i, t in enumerate(_COLLECTION) if 1 <= i <= 4
    ),
)
def datasets_by_id(spark, sf):
    entries = [(i, f"{sf}/{t}.parquet", None) for i, t in enumerate(_COLLECTION)]
    chosen = tables.select_datasets(tables.registry(spark, entries), 1, 4)
    return tables.dataset_sizes(tables.load_datasets(spark, chosen))


@query("csv_round_trip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf):
    part = table(spark, sf, "part")
    path = new_path(spark, "csv")
    tables.write_csv(part, path)
    return tables.read_csv(spark, path, part.schema)


@query("csv_inferred", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, sf):
    path = new_path(spark, "csv")
    tables.write_csv(table(spark, sf, "customer"), path)
    return tables.read_csv(spark, path)


@query(
    "tsv_result_folders",
    f"{WITH} SELECT concat('ds', ds_id) AS ds, model, count(*)::BIGINT AS n, max({F1}) AS best, round(sum({F1}), 4) AS total FROM perf_v GROUP BY 1, 2",
)
def tsv_result_folders(spark, sf):
    """Results as TSV per dataset and learner; both names come back from the folders."""
    perf = perf_view(spark, sf).select(
        F.concat(F.lit("ds"), F.col("ds_id").cast("string")).alias("ds"), "model", "solution", "rep", F1
    )
    path = new_path(spark, "tsv")
    tables.write_tsv(perf.hint("rebalance", "ds", "model"), path)
    back = tables.read_result_folders(spark, path, f"solution string, rep int, {F1} double")
    stats = back.groupBy("ds", "model").agg(
        F.count(F.lit(1)).alias("n"), F.max(F1).alias("best"), F.sum(F1).alias("total")
    )
    return rounded(stats, "total", digits=4)


@query(
    "tsv_round_trip",
    f"{WITH} SELECT ds_id, comb, initial_fk, fk, rl FROM risk_v",
)
def tsv_round_trip(spark, sf):
    risk = risk_view(spark, sf).select("ds_id", "comb", "initial_fk", "fk", "rl")
    path = new_path(spark, "tsv")
    tables.write_tsv(risk, path, [])
    return tables.read_tsv(spark, path, risk.schema)


@query(
    "risk_table_overwritten",
    f"{WITH} SELECT ds_id, comb, CASE WHEN ds_id >= 10 THEN rl / 2 ELSE rl END AS rl FROM risk_v",
)
def risk_table_overwritten(spark, sf):
    """A second run replaces the datasets it computed and leaves the others."""
    risk = risk_view(spark, sf).select("ds_id", "comb", "rl")
    path = new_path(spark, "risk")
    tables.write_by_dataset(risk, path)
    tables.write_by_dataset(risk.where("ds_id >= 10").withColumn("rl", F.col("rl") / 2), path)
    return tables.read_results(spark, path).select("ds_id", "comb", "rl")


@query(
    "cv_results_appended",
    f"{WITH} SELECT ds, model, rep, max({F1}) AS best FROM perf_v GROUP BY ALL",
)
def cv_results_appended(spark, sf):
    path = new_path(spark, "cv_results")
    perf = perf_view(spark, sf).select("ds", "model", "rep", F1)
    for rep in range(5):
        tables.append_results(perf.where(F.col("rep") == rep), path)
    return tables.read_results(spark, path).groupBy("ds", "model", "rep").agg(F.max(F1).alias("best"))


@query(
    "variants_round_trip",
    f"SELECT 0 AS variant_id, p_partkey, p_brand, {duck.round_to('p_retailprice', 5.0)}::VARCHAR AS p_retailprice FROM part "
    "UNION ALL SELECT 1, p_partkey, p_brand, '*' FROM part",
)
def variants_round_trip(spark, sf):
    """Variants whose schemas differ, each under its own folder."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    root = new_path(spark, "variants")
    tables.write_variant(fit_rounding(part, ["p_retailprice"], 5.0).transform(part), root, 0, 0)
    tables.write_variant(fit_suppression(part, ["p_retailprice"], 0.01).transform(part), root, 0, 1)
    back = [
        tables.read_variant(spark, root, 0, v).select(
            F.lit(v).alias("variant_id"), "p_partkey", "p_brand", F.col("p_retailprice").cast("string").alias("p_retailprice")
        )
        for v in (0, 1)
    ]
    return back[0].unionByName(back[1])


@query(
    "variants_as_csv",
    f"{WITH} SELECT ds_id, variant_id, count(*)::BIGINT AS n FROM perf_v GROUP BY ALL",
)
def variants_as_csv(spark, sf):
    """Variants exported by folder; ``ds_id`` and ``variant_id`` are partition columns."""
    perf = perf_view(spark, sf).select("ds_id", "variant_id", "model", F1)
    path = new_path(spark, "export")
    tables.write_csv(perf.hint("rebalance", "ds_id", "variant_id"), path, ["ds_id", "variant_id"])
    back = tables.read_csv(spark, path, f"model string, {F1} double, ds_id int, variant_id int")
    return back.groupBy("ds_id", "variant_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "combos_table",
    f"{WITH} SELECT ds_id, variant_id, len(string_split(solution, ', '))::INTEGER AS techniques FROM combos_v",
)
def combos_table(spark, sf):
    """The combination table keeps its arrays through a partitioned write."""
    path = new_path(spark, "combos")
    tables.write_by_dataset(combos_view(spark, sf), path)
    back = tables.read_results(spark, path)
    return back.select("ds_id", "variant_id", F.size("techniques").alias("techniques"))


@query(
    "stream_policy_events",
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), "
    "f AS (SELECT event_id, event_type, CASE WHEN value <= a - 1.5 * (b - a) THEN a - 1.5 * (b - a) "
    "WHEN value >= b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE value END AS value FROM events, q) "
    f"SELECT event_id, event_type, {duck.round_to('value', 5.0)} AS value FROM f",
)
def stream_policy_events(spark, sf):
    """Policies fitted on the table, applied to the same rows as a stream."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    policies = [fit_fences(events, ["value"], 1.5), fit_rounding(events, ["value"], 5.0)]
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    path = new_path(spark, "stream")
    run_available(protect_stream(stream, policies), path, f"{path}-checkpoint")
    return spark.read.schema(events.schema).parquet(path)
