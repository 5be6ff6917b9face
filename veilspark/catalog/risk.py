"""Queries on equivalence classes and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog import duck
from veilspark.catalog.base import query, rounded, table
from veilspark.functions.expressions import relative_error
from veilspark.operators.equivalence import (
    anonymity,
    cardinalities,
    class_histogram,
    pick_block,
    unique_share,
    with_class_size,
)
from veilspark.operators.linkage import linkage_risk, linked_pairs, linkage_rule
from veilspark.operators.rounding import fit_rounding
from veilspark.operators.suppression import fit_suppression

PART_QI = ["p_brand", "p_type", "p_size"]
ORDER_QI = ["o_orderstatus", "o_orderpriority", "o_orderdate"]
LINE_QI = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

PART_FIELDS = [("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True)]
ORDER_FIELDS = [("o_custkey", True), ("o_orderstatus", False), ("o_orderpriority", False), ("o_totalprice", True)]
CUSTOMER_FIELDS = [("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False)]
LINE_FIELDS = [(c, i < 3) for i, c in enumerate(LINE_QI)]


def names(fields):
    return [f for f, _ in fields]


def _fk_sql(source: str, qi: list[str]) -> str:
    cols = ", ".join(qi)
    return (
        "SELECT round(100e0 * coalesce(sum(n) FILTER (n = 1), 0) / sum(n), 6) AS fk "
        f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {cols})"
    )


@query("fk_part", _fk_sql("part", PART_QI))
def fk_part(spark, sf):
    return rounded(unique_share(table(spark, sf, "part"), PART_QI), "fk")


@query("fk_orders", _fk_sql("orders", ORDER_QI))
def fk_orders(spark, sf):
    return rounded(unique_share(table(spark, sf, "orders"), ORDER_QI), "fk")


@query("fk_lineitem", _fk_sql("lineitem", LINE_QI))
def fk_lineitem(spark, sf):
    return rounded(unique_share(table(spark, sf, "lineitem"), LINE_QI), "fk")


@query(
    "anonymity_lineitem",
    "SELECT min(n)::BIGINT AS k, round(100e0 * coalesce(sum(n) FILTER (n = 1), 0) / sum(n), 6) AS fk, "
    "count(*)::BIGINT AS classes, sum(n)::BIGINT AS rows "
    f"FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(LINE_QI)})",
)
def anonymity_lineitem(spark, sf):
    return rounded(anonymity(table(spark, sf, "lineitem"), LINE_QI), "fk")


@query(
    "class_sizes_lineitem",
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_discount, l_returnflag, l_linestatus)::BIGINT "
    "AS class_size FROM lineitem",
)
def class_sizes_lineitem(spark, sf):
    qi = ["l_discount", "l_returnflag", "l_linestatus"]
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *qi)
    return with_class_size(rows, qi).drop(*qi)


@query(
    "class_histogram_part",
    "SELECT n::BIGINT AS class_size, count(*)::BIGINT AS classes, sum(n)::BIGINT AS rows "
    f"FROM (SELECT count(*) AS n FROM part GROUP BY {', '.join(PART_QI)}) GROUP BY n",
)
def class_histogram_part(spark, sf):
    return class_histogram(table(spark, sf, "part"), PART_QI)


def _block_query(name: str, source: str, cols: list[str]):
    sql = (
        f"SELECT u.col AS \"column\", u.d::BIGINT AS distinct_values, u.n::BIGINT AS rows, u.col = b.blk AS chosen "
        f"FROM ({duck.cardinality_rows(source, cols)}) u, ({duck.block_choice(source, cols)}) b"
    )

    @query(name, sql)
    def run(spark, sf):
        df = table(spark, sf, source)
        stats = cardinalities(df, cols)
        chosen = pick_block(stats)
        rows = [(c, d, stats.rows, c == chosen) for c, d in stats.distinct.items()]
        return spark.createDataFrame(rows, "column string, distinct_values bigint, rows bigint, chosen boolean")

    return run


_block_query("block_column_part", "part", names(PART_FIELDS))
_block_query("block_column_orders", "orders", names(ORDER_FIELDS))
_block_query("block_column_customer", "customer", names(CUSTOMER_FIELDS))

PART_ROUNDED = f"x AS (SELECT * REPLACE ({duck.round_to('p_retailprice', 5.0)} AS p_retailprice) FROM part)"


def part_rounded(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", *names(PART_FIELDS))
    return part, fit_rounding(part, ["p_retailprice"], 5.0).transform(part)


@query(
    "rl_part_rounded",
    f"WITH {PART_ROUNDED} SELECT round(({duck.rl('x', 'part', PART_FIELDS, 'l.p_size = r.p_size', 3, 'p_partkey')}), 6) AS rl",
)
def rl_part_rounded(spark, sf):
    part, protected = part_rounded(spark, sf)
    return rounded(linkage_risk(protected, part, names(PART_FIELDS), "p_size", 3), "rl")


@query(
    "rl_part_default_score",
    f"WITH {PART_ROUNDED} SELECT round(({duck.rl('x', 'part', PART_FIELDS, 'l.p_brand = r.p_brand', 2, 'p_partkey')}), 6) AS rl",
)
def rl_part_default_score(spark, sf):
    part, protected = part_rounded(spark, sf)
    return rounded(linkage_risk(protected, part, names(PART_FIELDS), "p_brand"), "rl")


_INDEXED = (
    f"WITH {PART_ROUNDED}, a AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM x), "
    "o AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), "
    f"p AS (SELECT l.p_partkey AS k, l.i + r.i AS idx, {duck.score(PART_FIELDS)} AS s "
    "FROM a l JOIN o r ON l.p_size = r.p_size), "
    "m AS (SELECT k, count(*) AS c FROM p WHERE s > 1 AND s + idx >= 4 GROUP BY k) "
)


@query(
    "rl_part_indexed",
    _INDEXED + "SELECT round(100e0 * count(*) FILTER (c = 1) / (SELECT count(*) FROM part), 6) AS rl FROM m",
)
def rl_part_indexed(spark, sf):
    part, protected = part_rounded(spark, sf)
    found = linkage_risk(
        protected, part, names(PART_FIELDS), "p_size", score="indexed", id_cols=["p_partkey"]
    )
    return rounded(found, "rl")


@query(
    "rl_orders_rounded",
    f"WITH x AS (SELECT * REPLACE ({duck.round_to('o_totalprice', 5.0)} AS o_totalprice) FROM orders) "
    f"SELECT round(({duck.rl('x', 'orders', ORDER_FIELDS, 'l.o_custkey = r.o_custkey', 3, 'o_orderkey')}), 6) AS rl",
)
def rl_orders_rounded(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", *names(ORDER_FIELDS))
    protected = fit_rounding(orders, ["o_totalprice"], 5.0).transform(orders)
    return rounded(linkage_risk(protected, orders, names(ORDER_FIELDS), "o_custkey", 3), "rl")


@query(
    "rl_orders_hot_blocks",
    f"WITH x AS (SELECT * REPLACE ({duck.round_to('o_totalprice', 5.0)} AS o_totalprice) FROM orders) "
    f"SELECT round(({duck.rl('x', 'orders', ORDER_FIELDS, 'l.o_orderstatus = r.o_orderstatus', 3, 'o_orderkey')}), 6) AS rl",
)
def rl_orders_hot_blocks(spark, sf):
    """Each block holds a third of all orders; their pairs are never formed."""
    orders = table(spark, sf, "orders").select("o_orderkey", *names(ORDER_FIELDS))
    protected = fit_rounding(orders, ["o_totalprice"], 5.0).transform(orders)
    return rounded(linkage_risk(protected, orders, names(ORDER_FIELDS), "o_orderstatus", 3), "rl")


_HASHED = "SELECT event_id, event_type, {hash} AS h, value FROM events"
_HASHED_DUCK = _HASHED.format(hash="('0x' || substr(md5(event_id::VARCHAR), 1, 15))::BIGINT")


@query(
    "rl_events_hashed_ids",
    f"WITH o AS ({_HASHED_DUCK}), x AS (SELECT * REPLACE ({duck.round_to('value', 5.0)} AS value) FROM o), "
    "p AS (SELECT l.event_id AS k FROM x l JOIN o r ON l.event_type = r.event_type "
    "WHERE round(1e0 + greatest(0e0, 1e0 - abs(l.h::HUGEINT - r.h::HUGEINT)::DOUBLE / 2e0) "
    "+ greatest(0e0, 1e0 - abs(l.value - r.value) / 2e0), 9) >= 1.9e0), "
    "c AS (SELECT k FROM p GROUP BY k HAVING count(*) = 1) "
    "SELECT round(100e0 * (SELECT count(*) FROM c) / (SELECT count(*) FROM x), 6) AS rl",
)
def rl_events_hashed_ids(spark, sf):
    """A 60-bit hash is told apart to the last digit, in blocks of a fifth of all rows."""
    events = table(spark, sf, "events")
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 10).cast("bigint")
    events = events.select("event_id", "event_type", h.alias("h"), "value")
    protected = fit_rounding(events, ["value"], 5.0).transform(events)
    return rounded(linkage_risk(protected, events, ["event_type", "h", "value"], "event_type", 1.9), "rl")


@query(
    "rl_orders_infinite",
    "WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Infinity'::DOUBLE "
    "ELSE o_totalprice END AS x FROM orders), p AS (SELECT l.o_orderkey AS k FROM o l JOIN o r ON l.o_orderstatus = r.o_orderstatus "
    "WHERE round(1e0 + greatest(0e0, 1e0 - abs(l.o_custkey - r.o_custkey)::DOUBLE / 2e0) + CASE WHEN isfinite(l.x) AND isfinite(r.x) "
    "THEN greatest(0e0, 1e0 - abs(l.x - r.x) / 2e0) ELSE 0e0 END, 9) >= 2e0), "
    "c AS (SELECT k FROM p GROUP BY k HAVING count(*) = 1) "
    "SELECT round(100e0 * (SELECT count(*) FROM c) / (SELECT count(*) FROM o), 6) AS rl",
)
def rl_orders_infinite(spark, sf):
    """An infinite number agrees with nothing, not even with another one."""
    x = F.when(F.col("o_orderkey") % 3 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("x")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", x)
    return rounded(linkage_risk(orders, orders, ["o_orderstatus", "o_custkey", "x"], "o_orderstatus", 2), "rl")


_LINE_CLASSES = ", ".join(LINE_QI)


@query(
    "rl_lineitem_rounded",
    f"WITH a AS (SELECT row_number() OVER () AS k, * FROM (SELECT {_LINE_CLASSES}, count(*) AS w FROM "
    f"(SELECT * REPLACE ({duck.round_to('l_tax', 0.2)} AS l_tax) FROM lineitem) GROUP BY ALL)), "
    f"o AS (SELECT {_LINE_CLASSES}, count(*) AS w FROM lineitem GROUP BY ALL), "
    f"p AS ({duck.pairs('a', 'o', LINE_FIELDS, 'l.l_quantity = r.l_quantity', 4.5, 'l.k AS k, l.w AS lw, r.w AS rw')}) "
    "SELECT round(100e0 * coalesce(sum(lw), 0) / (SELECT count(*) FROM lineitem), 6) AS rl "
    "FROM (SELECT k, lw FROM p GROUP BY k, lw HAVING sum(rw) = 1)",
)
def rl_lineitem_rounded(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_QI)
    protected = fit_rounding(lines, ["l_tax"], 0.2).transform(lines)
    return rounded(linkage_risk(protected, lines, LINE_QI, "l_quantity", 4.5), "rl")


_WIDE_FIELDS = [
    ("l_suppkey", True), ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True), ("l_linenumber", True),
    ("l_returnflag", False), ("l_linestatus", False), ("l_month", False), ("l_parity", False),
]
_WIDE = (
    "SELECT row_number() OVER () AS k, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus, "
    "strftime(l_shipdate, '%Y-%m') AS l_month, (l_orderkey % 6)::VARCHAR AS l_parity FROM lineitem"
)


@query(
    "rl_lineitem_ten_fields",
    f"WITH o AS MATERIALIZED ({_WIDE}), x AS MATERIALIZED (SELECT * REPLACE ({duck.round_to('l_quantity', 5.0)} AS l_quantity, {duck.round_to('l_extendedprice', 5.0)} AS l_extendedprice, "
    f"{duck.round_to('l_tax', 5.0)} AS l_tax, {duck.round_to('l_discount', 5.0)} AS l_discount) FROM o) "
    f"SELECT round(({duck.rl('x', 'o', _WIDE_FIELDS, 'l.l_suppkey = r.l_suppkey', 7, 'k')}), 6) AS rl",
)
def rl_lineitem_ten_fields(spark, sf):
    """Ten fields, of which nine are compared and up to three may disagree; loaded keys are split."""
    kept = ["l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
    month, parity = F.date_format("l_shipdate", "yyyy-MM").alias("l_month"), (F.col("l_orderkey") % 6).cast("string").alias("l_parity")
    lines = table(spark, sf, "lineitem").select(*kept, month, parity)
    protected = fit_rounding(lines, ["l_quantity", "l_extendedprice", "l_tax", "l_discount"], 5.0).transform(lines)
    return rounded(linkage_risk(protected, lines, names(_WIDE_FIELDS), "l_suppkey", 7), "rl")


_SUPPRESSED = (
    "x AS (SELECT c_custkey, '*' AS c_name, c_nationkey, '*' AS c_acctbal, c_mktsegment FROM customer), "
    "y AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer)"
)
_SUPPRESSED_FIELDS = [(c, c == "c_nationkey") for c, _ in CUSTOMER_FIELDS]


@query(
    "rl_customer_suppressed",
    f"WITH {_SUPPRESSED} SELECT round(({duck.rl('x', 'y', _SUPPRESSED_FIELDS, 'l.c_nationkey = r.c_nationkey', 2, 'c_custkey')}), 6) AS rl",
)
def rl_customer_suppressed(spark, sf):
    customer = table(spark, sf, "customer")
    fields = names(CUSTOMER_FIELDS)
    protected = fit_suppression(customer, fields, 0.9).transform(customer)
    return rounded(linkage_risk(protected, customer, fields, "c_nationkey", 2), "rl")


@query(
    "rl_customer_names",
    f"WITH x AS (SELECT * REPLACE ({duck.round_to('c_acctbal', 10.0)} AS c_acctbal) FROM customer) "
    f"SELECT round(({duck.rl('x', 'customer', CUSTOMER_FIELDS, 'l.c_nationkey = r.c_nationkey', 3, 'c_custkey')}), 6) AS rl",
)
def rl_customer_names(spark, sf):
    """Names differ by a digit or two, so similar but unequal texts decide."""
    customer = table(spark, sf, "customer")
    protected = fit_rounding(customer, ["c_acctbal"], 10.0).transform(customer)
    return rounded(linkage_risk(protected, customer, names(CUSTOMER_FIELDS), "c_nationkey", 3), "rl")


@query(
    "linkage_pairs_part",
    f"WITH {PART_ROUNDED} SELECT p_partkey_protected, p_partkey_original, similarity, similarity AS score FROM "
    f"({duck.pairs('x', 'part', PART_FIELDS, 'l.p_size = r.p_size', 3, 'l.p_partkey AS p_partkey_protected, r.p_partkey AS p_partkey_original')})",
)
def linkage_pairs_part(spark, sf):
    part, protected = part_rounded(spark, sf)
    return linked_pairs(protected, part, names(PART_FIELDS), ["p_partkey"], "p_size", 3)


SUPPLIER_FIELDS = [("s_name", False), ("s_nationkey", True), ("s_acctbal", True)]


@query(
    "rl_full_index_supplier",
    f"WITH x AS (SELECT * REPLACE ({duck.round_to('s_acctbal', 5.0)} AS s_acctbal) FROM supplier) "
    f"SELECT round(({duck.rl('x', 'supplier', SUPPLIER_FIELDS, 'true', 2, 's_suppkey')}), 6) AS rl",
)
def rl_full_index_supplier(spark, sf):
    """No block: all originals are candidates, met through shared field values."""
    supplier = table(spark, sf, "supplier")
    protected = fit_rounding(supplier, ["s_acctbal"], 5.0).transform(supplier)
    found = linkage_risk(protected, supplier, names(SUPPLIER_FIELDS), None, 2, indexer="full")
    return rounded(found, "rl")


@query(
    "relative_error_part",
    f"WITH e AS (SELECT abs({duck.round_to('p_retailprice', 5.0)} - p_retailprice) / nullif(p_retailprice, 0) AS e FROM part) "
    "SELECT round(avg(e), 9) AS mean_error, round(max(e), 9) AS max_error, count(e)::BIGINT AS finite FROM e",
)
def relative_error_part(spark, sf):
    part, protected = part_rounded(spark, sf)
    both = protected.select("p_partkey", F.col("p_retailprice").alias("after")).join(
        part.select("p_partkey", "p_retailprice"), "p_partkey"
    )
    e = relative_error(F.col("p_retailprice"), F.col("after"))
    stats = both.select(e.alias("e")).agg(
        F.avg("e").alias("mean_error"), F.max("e").alias("max_error"), F.count("e").alias("finite")
    )
    return rounded(stats, "mean_error", "max_error", digits=9)


@query(
    "linkage_checks_orders",
    f"SELECT {len(ORDER_FIELDS)} AS fields, 'ok' AS accepted, 'failed' AS other_columns, 'failed' AS no_block, "
    "'failed' AS no_indexer, (SELECT count(*) FROM orders)::BIGINT AS rows",
)
def linkage_checks_orders(spark, sf):
    """A rejected linkage leaves a status instead of a number."""
    orders = table(spark, sf, "orders").select(*names(ORDER_FIELDS))

    def status(**kw) -> str:
        try:
            args = {"protected": orders, "original": orders, "fields": names(ORDER_FIELDS), "block": "o_custkey"}
            linkage_rule(**{**args, **kw})
            return "ok"
        except ValueError:
            return "failed"

    return orders.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(len(ORDER_FIELDS)).alias("fields"),
        F.lit(status()).alias("accepted"),
        F.lit(status(original=orders.drop("o_custkey"))).alias("other_columns"),
        F.lit(status(block="")).alias("no_block"),
        F.lit(status(indexer="")).alias("no_indexer"),
        "rows",
    )
