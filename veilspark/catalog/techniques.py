"""Queries on the de-identification techniques with given parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog import duck
from veilspark.catalog.base import query, rounded, table
from veilspark.catalog.risk import CUSTOMER_FIELDS, LINE_QI, PART_FIELDS, PART_QI, names
from veilspark.operators.compare import changed_values, tables_equal
from veilspark.operators.equivalence import unique_share
from veilspark.operators.fences import fit_fences, outlier_counts
from veilspark.operators.equivalence import cardinalities
from veilspark.operators.noise import class_diameters, fit_noise, noise_errors
from veilspark.operators.recoding import fit_recoding, integer_stats
from veilspark.operators.rounding import fit_decimals, fit_rounding
from veilspark.operators.schema import align_types, column_class, narrow_types, split_target
from veilspark.operators.suppression import fit_suppression
from veilspark.streaming.policies import protect_stream

# The noise of the registered queries has to be the same every time it is compared.
FIXED_SEED = "fixed-for-comparison"


# --- projections and types ------------------------------------------------------------


@query(
    "column_classes_lineitem",
    "SELECT c AS \"column\", k AS class, (SELECT count(*) FROM lineitem)::BIGINT AS rows FROM (VALUES "
    "('l_orderkey', 'integer'), ('l_partkey', 'integer'), ('l_suppkey', 'integer'), ('l_linenumber', 'integer'), "
    "('l_quantity', 'float'), ('l_extendedprice', 'float'), ('l_discount', 'float'), ('l_tax', 'float'), "
    "('l_returnflag', 'text'), ('l_linestatus', 'text'), ('l_shipdate', 'other')) t(c, k)",
)
def column_classes_lineitem(spark, sf):
    df = table(spark, sf, "lineitem")
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(column_class(f.dataType)).alias("class")) for f in df.schema]
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.explode(F.array(*rows)).alias("x"), "rows").select("x.*", "rows")


@query(
    "narrow_types_lineitem",
    "SELECT l_quantity::BIGINT AS l_quantity, l_discount, l_tax, count(*)::BIGINT AS n FROM lineitem "
    "WHERE (SELECT bool_and(l_quantity = floor(l_quantity)) FROM lineitem) GROUP BY ALL",
)
def narrow_types_lineitem(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    df = narrow_types(table(spark, sf, "lineitem").select(*cols))
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_target_labels",
    "SELECT quality, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids, 2 AS other_columns FROM labels GROUP BY quality",
)
def split_target_labels(spark, sf):
    labels = table(spark, sf, "labels")
    rest, _ = split_target(labels, "quality")
    joined = rest.join(labels.select("doc_id", "quality"), "doc_id")
    return joined.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.lit(len(rest.columns)).alias("other_columns")
    )


@query(
    "align_types_customer",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal::VARCHAR AS c_acctbal FROM customer",
)
def align_types_customer(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    protected = fit_suppression(customer, ["c_acctbal"], 0.9).transform(customer)
    return align_types(customer, protected)


# --- suppression ----------------------------------------------------------------------


@query(
    "suppress_customer",
    "WITH s AS (SELECT count(*) AS n, count(DISTINCT c_name) AS a, count(DISTINCT c_acctbal) AS b, "
    "count(DISTINCT c_nationkey) AS c, count(DISTINCT c_mktsegment) AS d FROM customer) "
    "SELECT c_custkey, CASE WHEN a > 0.9e0 * n THEN '*' ELSE c_name END AS c_name, "
    "CASE WHEN c > 0.9e0 * n THEN '*' ELSE c_nationkey::VARCHAR END AS c_nationkey, "
    "CASE WHEN b > 0.9e0 * n THEN '*' ELSE c_acctbal::VARCHAR END AS c_acctbal, "
    "CASE WHEN d > 0.9e0 * n THEN '*' ELSE c_mktsegment END AS c_mktsegment FROM customer, s",
)
def suppress_customer(spark, sf):
    customer = table(spark, sf, "customer")
    protected = fit_suppression(customer, names(CUSTOMER_FIELDS), 0.9).transform(customer)
    return protected.select("c_custkey", *[F.col(c).cast("string").alias(c) for c in names(CUSTOMER_FIELDS)])


# --- fences ---------------------------------------------------------------------------

_FENCE = (
    "SELECT quantile_cont({c}, 0.25) - {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
    "quantile_cont({c}, 0.75) + {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t}"
)


@query(
    "topbottom_events",
    f"WITH f AS ({_FENCE.format(c='value', f='1.5e0', t='events')}) SELECT event_id, "
    "round(CASE WHEN lo = hi THEN value WHEN value <= lo THEN lo WHEN value >= hi THEN hi ELSE value END, 6) AS value "
    "FROM events, f",
)
def topbottom_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return rounded(fit_fences(events, ["value"], 1.5).transform(events), "value")


@query(
    "topbottom_lineitem_int",
    f"WITH f AS ({_FENCE.format(c='l_linenumber', f='0.25e0', t='lineitem')}), v AS (SELECT "
    "(CASE WHEN lo = hi THEN l_linenumber WHEN l_linenumber <= lo THEN trunc(lo) WHEN l_linenumber >= hi THEN trunc(hi) "
    "ELSE l_linenumber END)::INTEGER AS l_linenumber FROM lineitem, f) "
    "SELECT l_linenumber, count(*)::BIGINT AS n FROM v GROUP BY l_linenumber",
)
def topbottom_lineitem_int(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_linenumber")
    coded = fit_fences(lines, ["l_linenumber"], 0.25).transform(lines)
    return coded.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(
    "outlier_counts_events",
    f"WITH f AS ({_FENCE.format(c='value', f='1.5e0', t='events')}), g AS ({_FENCE.format(c='user_id', f='1.5e0', t='events')}) "
    "SELECT 'value' AS \"column\", round(lo, 6) AS lower, round(hi, 6) AS upper, "
    "count(*) FILTER (lo <> hi AND (value <= lo OR value >= hi))::BIGINT AS outliers FROM events, f GROUP BY lo, hi "
    "UNION ALL SELECT 'user_id', round(lo, 6), round(hi, 6), "
    "count(*) FILTER (lo <> hi AND (user_id <= lo OR user_id >= hi))::BIGINT FROM events, g GROUP BY lo, hi",
)
def outlier_counts_events(spark, sf):
    events = table(spark, sf, "events").select("value", "user_id")
    return rounded(outlier_counts(events, fit_fences(events, ["value", "user_id"], 1.5)), "lower", "upper")


# --- rounding -------------------------------------------------------------------------


@query(
    "round_base_orders",
    f"SELECT o_orderkey, {duck.round_to('o_totalprice', 5.0)} AS o_totalprice FROM orders",
)
def round_base_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return fit_rounding(orders, ["o_totalprice"], 5.0).transform(orders)


@query(
    "round_base_int_part",
    f"SELECT p_partkey, trunc({duck.round_to('p_size', 10.0)})::INTEGER AS p_size, "
    f"round({duck.round_to('p_retailprice', 0.2)}, 6) AS p_retailprice FROM part",
)
def round_base_int_part(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    sizes = fit_rounding(part, ["p_size"], 10.0).transform(part)
    return rounded(fit_rounding(part, ["p_retailprice"], 0.2).transform(sizes), "p_retailprice")


@query(
    "round_floats_lineitem",
    "WITH v AS (SELECT round_even(l_discount, 1) AS l_discount, round_even(l_tax, 1) AS l_tax FROM lineitem) "
    "SELECT l_discount, l_tax, count(*)::BIGINT AS n FROM v GROUP BY ALL",
)
def round_floats_lineitem(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_discount", "l_tax")
    short = fit_decimals(lines, digits=1).transform(lines)
    return short.groupBy("l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n"))


# --- recoding -------------------------------------------------------------------------

_SIZE_STATS = "s AS (SELECT min(p_size) AS low, trunc(0.5e0 * stddev_pop(p_size))::INTEGER AS width FROM part)"


@query(
    "recode_part",
    f"WITH {_SIZE_STATS} SELECT p_partkey, ({duck.recode('p_size', 'low', 'width')})::INTEGER AS p_size FROM part, s",
)
def recode_part(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return fit_recoding(part, ["p_size"], 0.5).transform(part)


@query(
    "recode_widths_part",
    "SELECT 'p_size' AS \"column\", m AS magnitude, trunc(m * s)::BIGINT AS width, low::BIGINT AS low, round(s, 9) AS sigma "
    "FROM (SELECT stddev_pop(p_size) AS s, min(p_size) AS low FROM part), (VALUES (0.5e0), (1.5e0)) t(m)",
)
def recode_widths_part(spark, sf):
    stats = integer_stats(table(spark, sf, "part"), ["p_size"])
    rows = [(c, m, s.width(m), s.low, round(s.sigma, 9)) for c, s in stats.items() for m in (0.5, 1.5)]
    return spark.createDataFrame(rows, "column string, magnitude double, width bigint, low bigint, sigma double")


_RECODED = f"r AS (SELECT p_brand, p_type, {duck.recode('p_size', 'low', 'width')} AS p_size FROM part, s)"
_FK = "(SELECT round(100e0 * coalesce(sum(n) FILTER (n = 1), 0) / sum(n), 6) FROM (SELECT count(*) AS n FROM {t} GROUP BY p_brand, p_type, p_size))"


@query(
    "recode_effect_part",
    f"WITH {_SIZE_STATS}, {_RECODED} SELECT {_FK.format(t='part')} AS fk_before, {_FK.format(t='r')} AS fk_after",
)
def recode_effect_part(spark, sf):
    """``fk`` before and after the sizes are recoded to bins of half a deviation."""
    part = table(spark, sf, "part").select(*PART_QI)
    recoded = fit_recoding(part, ["p_size"], 0.5).transform(part)
    before = unique_share(part, PART_QI, "fk_before").withColumn("fk_after", F.lit(None).cast("double"))
    after = unique_share(recoded, PART_QI, "fk_after").withColumn("fk_before", F.lit(None).cast("double"))
    both = before.unionByName(after).agg(F.max("fk_before").alias("fk_before"), F.max("fk_after").alias("fk_after"))
    return rounded(both, "fk_before", "fk_after")


# --- noise ----------------------------------------------------------------------------

_DIAM = (
    "d AS (SELECT p_size, p_brand, max(p_retailprice) - min(p_retailprice) AS diam FROM part GROUP BY p_size, p_brand), "
    "j AS (SELECT p_partkey, p_retailprice, diam FROM part JOIN d USING (p_size, p_brand))"
)


def _noisy(epsilon: float) -> str:
    u = duck.uniform(FIXED_SEED, "p_partkey", f"'p_retailprice:{epsilon:g}'")
    return duck.laplace("p_retailprice", "diam", epsilon, u)


@query(
    "laplace_part",
    f"WITH {_DIAM} SELECT p_partkey, round({_noisy(0.5)}, 4) AS p_retailprice FROM j",
)
def laplace_part(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", *names(PART_FIELDS))
    policy = fit_noise(part, ["p_partkey"], FIXED_SEED, classes=["p_size", "p_brand"], epsilon=0.5)
    return rounded(policy.transform(part).select("p_partkey", "p_retailprice"), "p_retailprice", digits=4)


@query(
    "class_diameters_part",
    "SELECT p_size, p_brand, round(max(p_retailprice) - min(p_retailprice), 6) AS diam FROM part GROUP BY p_size, p_brand",
)
def class_diameters_part(spark, sf):
    part = table(spark, sf, "part")
    policy = fit_noise(part, ["p_partkey"], FIXED_SEED, ["p_retailprice"], ["p_size", "p_brand"])
    named = policy.diameters.withColumnRenamed("diam_p_retailprice", "diam")
    return rounded(named, "diam")


_ERRORS = " UNION ALL ".join(
    f"SELECT {e!r}::DOUBLE AS epsilon, avg(abs({_noisy(e)} - p_retailprice) / nullif(p_retailprice, 0)) AS e FROM j"
    for e in (0.5, 2.0, 4.0, 8.0, 16.0)
)


@query(
    "laplace_eps_search_part",
    f"WITH {_DIAM}, e AS ({_ERRORS}) SELECT 'p_retailprice' AS \"column\", epsilon, round(e, 6) AS mean_error, "
    "epsilon = (SELECT arg_min(epsilon, abs(e)) FROM e) AS chosen FROM e",
)
def laplace_eps_search_part(spark, sf):
    from veilspark.operators.search import search_noise

    part = table(spark, sf, "part").select("p_partkey", *names(PART_FIELDS))
    _, report = search_noise(part, ["p_partkey"], FIXED_SEED, classes=["p_size", "p_brand"])
    return rounded(report, "mean_error")


@query(
    "laplace_errors_part",
    f"WITH {_DIAM}, e AS ({_ERRORS}) SELECT 'p_retailprice' AS \"column\", epsilon, round(e, 6) AS mean_error FROM e",
)
def laplace_errors_part(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", *names(PART_FIELDS))
    policy = fit_noise(part, ["p_partkey"], FIXED_SEED, classes=["p_size", "p_brand"])
    return rounded(noise_errors(part, policy), "mean_error")


# --- whole tables ---------------------------------------------------------------------


@query(
    "no_eligible_column_customer",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def no_eligible_column_customer(spark, sf):
    """Techniques without an eligible column leave the table as it is."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    texts = ["c_name", "c_mktsegment"]
    policies = [
        fit_fences(customer, texts),
        fit_rounding(customer, texts),
        fit_recoding(customer, texts),
        fit_decimals(customer, texts),
        fit_noise(customer, ["c_custkey"], FIXED_SEED, texts),
    ]
    return protect_stream(customer, policies)


@query(
    "tables_equal_part",
    f"WITH x AS (SELECT p_partkey, {duck.round_to('p_retailprice', 5.0)} AS p FROM part) "
    "SELECT count(*) = 0 AS equal, count(*)::BIGINT AS differing_rows FROM x JOIN part USING (p_partkey) WHERE p <> p_retailprice",
)
def tables_equal_part(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return tables_equal(fit_rounding(part, ["p_retailprice"], 5.0).transform(part), part, ["p_partkey"])


@query(
    "tables_equal_lineitem_bag",
    f"WITH x AS (SELECT l_quantity, {duck.round_to('l_tax', 0.2)} AS l_tax FROM lineitem), "
    "a AS (SELECT * FROM x EXCEPT ALL SELECT l_quantity, l_tax FROM lineitem), "
    "b AS (SELECT l_quantity, l_tax FROM lineitem EXCEPT ALL SELECT * FROM x) "
    "SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) = 0 AS equal, "
    "((SELECT count(*) FROM a) + (SELECT count(*) FROM b))::BIGINT AS differing_rows",
)
def tables_equal_lineitem_bag(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_tax")
    return tables_equal(fit_rounding(lines, ["l_tax"], 0.2).transform(lines), lines)


@query(
    "changed_values_customer",
    f"WITH x AS (SELECT c_custkey, {duck.round_to('c_acctbal', 10.0)} AS c_acctbal, c_mktsegment FROM customer) "
    "SELECT 'c_acctbal' AS \"column\", count(*) FILTER (x.c_acctbal <> c.c_acctbal)::BIGINT AS changed "
    "FROM x JOIN customer c USING (c_custkey) UNION ALL "
    "SELECT 'c_mktsegment', count(*) FILTER (x.c_mktsegment <> c.c_mktsegment)::BIGINT FROM x JOIN customer c USING (c_custkey)",
)
def changed_values_customer(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    protected = fit_rounding(customer, ["c_acctbal"], 10.0).transform(customer)
    return changed_values(protected, customer, ["c_custkey"])


@query(
    "combo_fixed_part",
    f"WITH f AS ({_FENCE.format(c='p_retailprice', f='0.25e0', t='part')}), "
    "t AS (SELECT p_partkey, p_size, CASE WHEN p_retailprice <= lo THEN lo WHEN p_retailprice >= hi THEN hi ELSE p_retailprice END AS p FROM part, f), "
    f"r AS (SELECT p_partkey, trunc({duck.round_to('p_size', 5.0)})::INTEGER AS p_size, {duck.round_to('p', 5.0)} AS p FROM t), "
    "s AS (SELECT min(p_size) AS low, trunc(0.5e0 * stddev_pop(p_size))::INTEGER AS width FROM r) "
    f"SELECT p_partkey, ({duck.recode('p_size', 'low', 'width')})::INTEGER AS p_size, round(p, 6) AS p_retailprice FROM r, s",
)
def combo_fixed_part(spark, sf):
    """Fences, rounding and recoding one after the other, each fitted on the last result."""
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    df = fit_fences(df, ["p_retailprice"], 0.25).transform(df)
    df = fit_rounding(df, ["p_size", "p_retailprice"], 5.0).transform(df)
    df = fit_recoding(df, ["p_size"], 0.5).transform(df)
    return rounded(df, "p_retailprice")


@query(
    "lineitem_recoded_fk",
    "WITH s AS (SELECT min(l_quantity::BIGINT) AS low, trunc(0.5e0 * stddev_pop(l_quantity))::BIGINT AS width FROM lineitem), "
    f"r AS (SELECT {duck.recode('l_quantity::BIGINT', 'low', 'width')} AS l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem, s) "
    f"SELECT round(100e0 * coalesce(sum(n) FILTER (n = 1), 0) / sum(n), 6) AS fk FROM (SELECT count(*) AS n FROM r GROUP BY {', '.join(LINE_QI)})",
)
def lineitem_recoded_fk(spark, sf):
    """Narrow, recode and score: the quantities are whole numbers stored as doubles."""
    lines = narrow_types(table(spark, sf, "lineitem").select(*LINE_QI))
    recoded = fit_recoding(lines, ["l_quantity"], 0.5).transform(lines)
    return rounded(unique_share(recoded, LINE_QI), "fk")


_NAN_DUCK = "WITH e AS (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"


def _with_nan(spark, sf):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(float("nan"))
    return table(spark, sf, "events").select("event_type", v.alias("v"))


@query(
    "outlier_counts_nan",
    f"{_NAN_DUCK}, q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM e) "
    "SELECT 'v' AS \"column\", round(a - 1.5e0 * (b - a), 6) AS lower, round(b + 1.5e0 * (b - a), 6) AS upper, "
    "(SELECT count(*) FROM e, q WHERE v <= a - 1.5e0 * (b - a) OR v >= b + 1.5e0 * (b - a))::BIGINT AS outliers FROM q",
)
def outlier_counts_nan(spark, sf):
    """Not-a-number moves no quartile and is no outlier."""
    events = _with_nan(spark, sf)
    return rounded(outlier_counts(events, fit_fences(events, ["v"])), "lower", "upper")


@query(
    "diameters_nan",
    f"{_NAN_DUCK} SELECT event_type, round(max(v) - min(v), 6) AS diam_v FROM e GROUP BY event_type",
)
def diameters_nan(spark, sf):
    """Not-a-number does not spoil the diameter of its class."""
    return rounded(class_diameters(_with_nan(spark, sf), ["v"], ["event_type"]), "diam_v")


@query("cardinality_nan", f"{_NAN_DUCK} SELECT count(DISTINCT v)::BIGINT AS distinct_v, count(*)::BIGINT AS n FROM e")
def cardinality_nan(spark, sf):
    found = cardinalities(_with_nan(spark, sf), ["v"])
    return spark.range(1).select(F.lit(found.distinct["v"]).cast("bigint").alias("distinct_v"), F.lit(found.rows).cast("bigint").alias("n"))
