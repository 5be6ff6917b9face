"""Queries on encoding, splitting, scoring and training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.catalog.analysis import WITH
from veilspark.catalog.base import perf_view, query, rounded, table
from veilspark.functions.ranking import dense_codes
from veilspark.functions.relations import join_on_class
from veilspark.plans import features, modeling
from veilspark.plans.metrics import confusion, fold_means, metrics

SEED = "split"


def labelled_documents(spark, sf):
    """Labels with what is known about their documents; the target is ``quality``."""
    documents = table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        "source",
        (F.col("n_chars") / 1000.5).alias("kchars"),
        F.size(F.split("text", "\n")).alias("lines"),
        F.size(F.split("text", " ")).alias("words"),
    )
    return table(spark, sf, "labels").join(documents, "doc_id")


# --- encoding -------------------------------------------------------------------------


@query(
    "encode_ordinal",
    "SELECT c_custkey, CASE WHEN (SELECT count(DISTINCT c_name) > 0.7e0 * count(*) FROM customer) "
    "THEN dense_rank() OVER (ORDER BY c_name) - 1 END::DOUBLE AS c_name, c_mktsegment FROM customer",
)
def encode_ordinal(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return features.encode_many_levels(customer, ["c_name", "c_mktsegment"])


@query(
    "encode_ordinal_ranges",
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d')) - 1)::BIGINT AS code FROM orders",
)
def encode_ordinal_ranges(spark, sf):
    """The same numbering with the values cut into ranges, as for very many values."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    codes = dense_codes(orders, "day", "code", single_task_limit=100, buckets=16)
    return join_on_class(orders, codes, ["day"], "left").select("o_orderkey", "code")


@query(
    "encode_onehot",
    "SELECT c_custkey, c_nationkey, "
    + ", ".join(
        f"(c_mktsegment = '{s}')::INTEGER AS \"c_mktsegment_{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def encode_onehot(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return features.one_hot_columns(customer, ["c_mktsegment"])


@query(
    "encode_onehot_vector",
    "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS position FROM part",
)
def encode_onehot_vector(spark, sf):
    """Sparse vectors for any number of levels; the position of the 1 is compared."""
    from pyspark.ml.functions import vector_to_array

    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    coded = features.one_hot_vector(part, "p_brand", "v")
    position = F.array_position(vector_to_array("v"), F.lit(1.0)) - 1
    return coded.select("p_partkey", position.cast("bigint").alias("position"))


@query(
    "encode_onehot_nulls",
    "WITH b AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS few, "
    "CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(p_brand, '-', p_size) END AS many FROM part) SELECT p_partkey, "
    + ", ".join(
        f"(CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END)::BIGINT AS {c}, "
        f"(SELECT count(DISTINCT {c}) FROM b)::BIGINT AS {c}_size"
        for c in ("few", "many")
    )
    + " FROM b",
)
def encode_onehot_nulls(spark, sf):
    """Nulls have no 1 anywhere, whether a column has few levels or hundreds."""
    from pyspark.ml.functions import vector_to_array

    few = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    many = F.when(F.col("p_size") % 7 != 0, F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    coded = table(spark, sf, "part").select("p_partkey", few.alias("few"), many.alias("many"))
    for c in ("few", "many"):
        coded = features.one_hot_vector(coded, c, f"{c}_v")
        array = vector_to_array(f"{c}_v")
        position = (F.array_position(array, F.lit(1.0)) - 1).cast("bigint")
        coded = coded.withColumns({c: position, f"{c}_size": F.size(array).cast("bigint")})
    return coded.select("p_partkey", "few", "few_size", "many", "many_size")


@query(
    "drop_near_unique",
    "SELECT p_size, count(*)::BIGINT AS n FROM part "
    "WHERE (SELECT count(DISTINCT p_partkey) > 0.9e0 * count(*) AND count(DISTINCT p_size) <= 0.9e0 * count(*) FROM part) GROUP BY p_size",
)
def drop_near_unique(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    left = features.drop_near_unique(part, part.columns)
    return left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_encode",
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS label FROM orders",
)
def label_encode(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return features.encode_target(orders, "o_orderstatus").select("o_orderkey", "label")


# --- splitting ------------------------------------------------------------------------


def _ranked(source: str, group: str, key: str) -> str:
    return (
        f"(SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5(concat_ws('|', '{SEED}', {key}::VARCHAR)), {key}) AS rn, "
        f"count(*) OVER (PARTITION BY {group}) AS n FROM {source})"
    )


@query(
    "split_stratified",
    f"SELECT doc_id, quality, rn <= round(0.2e0 * n) AS is_test FROM {_ranked('labels', 'quality', 'doc_id')}",
)
def split_stratified(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return features.stratified_split(labels, "quality", ["doc_id"], SEED)


@query(
    "split_stratified_orders",
    f"SELECT o_orderstatus, rn <= round(0.2e0 * n) AS is_test, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM {_ranked('orders', 'o_orderstatus', 'o_orderkey')} GROUP BY 1, 2",
)
def split_stratified_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    split = features.stratified_split(orders, "o_orderstatus", ["o_orderkey"], SEED)
    return split.groupBy("o_orderstatus", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )


@query(
    "folds_stratified",
    f"SELECT o_orderkey, o_orderstatus, ((rn - 1) % 5)::INTEGER AS fold FROM {_ranked('orders', 'o_orderstatus', 'o_orderkey')}",
)
def folds_stratified(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return features.stratified_folds(orders, "o_orderstatus", ["o_orderkey"], SEED)


# --- scoring --------------------------------------------------------------------------

_PREDICTED = (
    "WITH p AS (SELECT (doc_id % 5)::INTEGER AS fold, quality::DOUBLE AS label, (n_chars > 900)::INTEGER::DOUBLE AS prediction FROM labels JOIN documents USING (doc_id)), "
    "c AS (SELECT fold, label AS c, count(*) AS support, count(*) FILTER (prediction = label) AS hits FROM p GROUP BY ALL), "
    "q AS (SELECT fold, prediction AS c, count(*) AS called FROM p GROUP BY ALL), "
    "k AS (SELECT fold, c, support, hits, hits / support AS recall, 2e0 * hits / (support + coalesce(called, 0)) AS f1 FROM c LEFT JOIN q USING (fold, c)), "
    "m AS (SELECT fold, CASE WHEN min(recall) = 0 THEN 0e0 ELSE exp(avg(ln(CASE WHEN recall > 0 THEN recall END))) END AS gmean, sum(hits) / sum(support) AS acc, "
    "avg(recall) AS bal_acc, coalesce(max(CASE WHEN c = 1 THEN f1 END), 0e0) AS f1, sum(f1 * support) / sum(support) AS f1_weighted FROM k GROUP BY fold) "
)
_METRICS = ("gmean", "acc", "bal_acc", "f1", "f1_weighted")


def _predicted(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    return rows.select(
        F.pmod("doc_id", F.lit(5)).cast("int").alias("fold"),
        F.col("quality").cast("double").alias("label"),
        (F.col("n_chars") > 900).cast("int").cast("double").alias("prediction"),
    )


@query(
    "metrics_from_predictions",
    _PREDICTED + "SELECT fold, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM m",
)
def metrics_from_predictions(spark, sf):
    return rounded(metrics(confusion(_predicted(spark, sf), ["fold"]), ["fold"]), *_METRICS)


@query(
    "metrics_fold_means",
    _PREDICTED + "SELECT " + ", ".join(f"round(avg({m}), 6) AS mean_test_{m}" for m in _METRICS) + " FROM m",
)
def metrics_fold_means(spark, sf):
    per_fold = metrics(confusion(_predicted(spark, sf), ["fold"]), ["fold"])
    return rounded(fold_means(per_fold, []), *[f"mean_test_{m}" for m in _METRICS])


@query(
    "run_plan",
    f"{WITH}, d AS (SELECT DISTINCT ds FROM perf_v), p AS (SELECT ds, rep FROM d, (SELECT unnest(range(0, 5))::INTEGER AS rep)) "
    "SELECT ds, rep FROM p WHERE (ds, rep) NOT IN (SELECT ds, rep FROM perf_v WHERE model = 'RF')",
)
def run_plan(spark, sf):
    """Runs that have no result of the forest yet."""
    perf = perf_view(spark, sf)
    plan = modeling.run_plan(perf.select("ds").distinct())
    return modeling.open_runs(plan, perf.where("model = 'RF'"))


# --- training: rows only --------------------------------------------------------------


def _folds(spark, sf):
    prepared = features.prepare(labelled_documents(spark, sf).drop("toxic"), "quality", ["doc_id"])
    split = features.stratified_split(prepared.table, "label", ["doc_id"], SEED)
    train = features.stratified_folds(split.where(~F.col("is_test")), "label", ["doc_id"], SEED).persist()
    return prepared, train, split.where("is_test")


def _register_cv(name: str, model: str) -> None:
    @query(name)
    def run(spark, sf):
        prepared, train, _ = _folds(spark, sf)
        cv = modeling.cross_validate(prepared, train, model)
        train.unpersist()
        score_columns = [c for c in cv.scores.columns if c.startswith("mean_")]
        scores = cv.scores.withColumn("params", F.to_json("params")).drop("number")
        return rounded(scores, *score_columns)


for _name, _model in (
    ("cv_random_forest", "RF"),
    ("cv_bagging", "Bag"),
    ("cv_boosting", "XGB"),
    ("cv_logistic", "LogR"),
    ("cv_network", "NN"),
):
    _register_cv(_name, _model)


@query("cv_holdout")
def cv_holdout(spark, sf):
    """The best of every learner's grid, refitted and scored on the test rows."""
    prepared, train, test = _folds(spark, sf)
    found = [modeling.cross_validate(prepared, train, m) for m in modeling.FULL_GRIDS]
    finals = reduce(DataFrame.unionByName, [modeling.hold_out(prepared, train, test, cv.model, cv.best) for cv in found])
    train.unpersist()
    return rounded(finals, *_METRICS)
