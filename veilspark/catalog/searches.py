"""Queries that pick parameters and combinations by the risk that is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog import duck
from veilspark.catalog.base import query, rounded, table
from veilspark.catalog.risk import CUSTOMER_FIELDS, LINE_QI, PART_FIELDS, names
from veilspark.catalog.techniques import FIXED_SEED
from veilspark.operators.schema import combinations_frame, eligible_techniques, narrow_types, technique_combinations
from veilspark.operators.search import (
    search_fences,
    search_recoding,
    search_rounding,
    search_suppression,
)
from veilspark.plans.deidentify import evaluate, risk_report, study_of, surviving_combinations

PART = names(PART_FIELDS)
PART_COLS = ", ".join(PART)


def _chosen(sql: str, least_last: str) -> str:
    """Mark the candidate with the least risk; ``least_last`` is min or max of the ties."""
    return (
        f"WITH c AS ({sql}) SELECT parameter, round(risk, 6) AS risk, block_col, "
        f"parameter = (SELECT {least_last}(parameter) FROM c WHERE risk = (SELECT min(risk) FROM c)) AS chosen FROM c"
    )


def _link_candidates(key, tables: dict[float, tuple[str, str]], fields, original: str, min_score: float) -> str:
    """Union of one linked candidate per parameter; tables map to (name, SQL)."""
    parts = []
    for p, (name, sql) in tables.items():
        ctes = f"{name} AS ({sql}), " + duck.searched_rl(name, name, original, fields, min_score, key)
        parts.append(
            f"SELECT {p!r}::DOUBLE AS parameter, risk, blk AS block_col FROM (WITH {ctes} SELECT * FROM {name}_rl)"
        )
    return " UNION ALL ".join(parts)


_SUP_FIELDS = [(c, c == "c_nationkey") for c in names(CUSTOMER_FIELDS)]
_SUP_SQL = "SELECT c_custkey, '*' AS c_name, c_nationkey, '*' AS c_acctbal, c_mktsegment FROM customer"
_SUP_ORIG = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer)"


@query(
    "suppress_search_customer",
    _chosen(
        _link_candidates(
            "c_custkey", {p: (f"s{i}", _SUP_SQL) for i, p in enumerate((0.7, 0.8, 0.9))}, _SUP_FIELDS, _SUP_ORIG, 2
        ),
        "max",
    ),
)
def suppress_search_customer(spark, sf):
    customer = table(spark, sf, "customer")
    found = search_suppression(customer, customer, names(CUSTOMER_FIELDS), min_score=2)
    return rounded(found.frame(spark), "risk")


def _fenced(cols: dict[str, bool], source: str, factor: float, key: str, rest: list[str]) -> str:
    stats = ", ".join(
        f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in cols
    )
    coded = []
    for c, whole in cols.items():
        lo, hi = f"(a_{c} - {factor!r} * (b_{c} - a_{c}))", f"(b_{c} + {factor!r} * (b_{c} - a_{c}))"
        edge = (lambda x: f"trunc({x})::BIGINT") if whole else (lambda x: x)
        coded.append(
            f"CASE WHEN {lo} = {hi} THEN {c} WHEN {c} <= {lo} THEN {edge(lo)} WHEN {c} >= {hi} THEN {edge(hi)} ELSE {c} END AS {c}"
        )
    return f"SELECT {key}, {', '.join(rest + coded)} FROM {source}, (SELECT {stats} FROM {source})"


_EVENT_FIELDS = [("event_type", False), ("user_id", True), ("value", True)]


@query(
    "topbottom_search_events",
    _chosen(
        _link_candidates(
            "event_id",
            {
                f: (f"t{i}", _fenced({"user_id": True, "value": False}, "events", f, "event_id", ["event_type"]))
                for i, f in enumerate((1.5, 3.0))
            },
            _EVENT_FIELDS, "events", 3,
        ),
        "min",
    ),
)
def topbottom_search_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", *names(_EVENT_FIELDS))
    found = search_fences(events, events, names(_EVENT_FIELDS), min_score=3, id_cols=["event_id"])
    return rounded(found.frame(spark), "risk")


def _rounded_part(base: float, source: str = "part") -> str:
    return (
        f"SELECT p_partkey, p_brand, p_type, trunc({duck.round_to('p_size', base)})::INTEGER AS p_size, "
        f"{duck.round_to('p_retailprice', base)} AS p_retailprice FROM {source}"
    )


_ROUND_CANDIDATES = _link_candidates(
    "p_partkey", {b: (f"b{i}", _rounded_part(b)) for i, b in enumerate((0.2, 5.0, 10.0))}, PART_FIELDS, "part", 3
)


@query("round_search_part", _chosen(_ROUND_CANDIDATES, "min"))
def round_search_part(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", *PART)
    return rounded(search_rounding(part, part, PART, min_score=3).frame(spark), "risk")


def _recode_candidates(source: str, cols: dict[str, str], fixed: list[str]) -> str:
    """All width combinations in order: candidate, widths, fk."""
    stats = ", ".join(
        f"min({e}) AS low_{c}, trunc(0.5e0 * stddev_pop({e}))::BIGINT AS w0_{c}, trunc(1.5e0 * stddev_pop({e}))::BIGINT AS w1_{c}"
        for c, e in cols.items()
    )
    n = len(cols)
    parts = []
    for k in range(2**n):
        bits = [(k >> (n - 1 - i)) & 1 for i in range(n)]
        widths = [f"w{b}_{c}" for b, c in zip(bits, cols)]
        keys = [f"{duck.recode(f'({e})', f'low_{c}', w)} AS k_{c}" for (c, e), w in zip(cols.items(), widths)]
        names_ = ", ".join([f"k_{c}" for c in cols] + fixed)
        parts.append(
            f"SELECT {k} AS candidate, (SELECT [{', '.join(f'{w}::INTEGER' for w in widths)}] FROM st) AS widths, "
            "100e0 * coalesce(sum(n) FILTER (n = 1), 0) / sum(n) AS fk FROM (SELECT count(*) AS n FROM "
            f"(SELECT {', '.join(keys + fixed)} FROM {source}, st) GROUP BY {names_})"
        )
    return f"WITH st AS (SELECT {stats} FROM {source}) {' UNION ALL '.join(parts)}"


def _recode_search(source: str, cols: dict[str, str], fixed: list[str]) -> str:
    return (
        f"WITH c AS ({_recode_candidates(source, cols, fixed)}) SELECT candidate, array_to_string(widths, ',') AS widths, "
        "round(fk, 6) AS fk, candidate = (SELECT min(candidate) FROM c WHERE fk = (SELECT min(fk) FROM c)) AS chosen FROM c"
    )


@query("recode_search_part", _recode_search("part", {"p_size": "p_size::BIGINT"}, ["p_brand", "p_type"]))
def recode_search_part(spark, sf):
    part = table(spark, sf, "part").select(*PART)
    return _widths_text(search_recoding(part, PART).frame(spark))


_LINE_INTS = ["l_quantity", "l_linenumber"]


@query(
    "recode_search_lineitem",
    _recode_search(
        "lineitem", {"l_quantity": "l_quantity::BIGINT", "l_linenumber": "l_linenumber::BIGINT"},
        ["l_shipdate", "l_returnflag", "l_linestatus"],
    ),
)
def recode_search_lineitem(spark, sf):
    """Two whole-number columns: four combinations of widths."""
    fields = [*_LINE_INTS, "l_discount", "l_shipdate", "l_returnflag", "l_linestatus"]
    lines = narrow_types(table(spark, sf, "lineitem").select(*fields), ["l_quantity"])
    return _widths_text(search_recoding(lines, fields).frame(spark))


def _widths_text(df):
    return rounded(df.withColumn("widths", F.array_join(F.col("widths").cast("array<string>"), ",")), "fk")


# --- combinations ---------------------------------------------------------------------

_ALL_COMBOS = (
    "WITH f AS (SELECT bool_and(l_quantity = floor(l_quantity)) AND bool_and(l_discount = floor(l_discount)) AS whole FROM lineitem), "
    "m AS (SELECT range AS m FROM range(1, 32)), "
    "t AS (SELECT m, array_to_string(list_sort(list_filter([CASE WHEN m & 1 > 0 THEN 'sup' END, CASE WHEN m & 2 > 0 THEN 'topbot' END, "
    "CASE WHEN m & 4 > 0 THEN 'noise' END, CASE WHEN m & 8 > 0 THEN 'round' END, CASE WHEN m & 16 > 0 THEN 'globalrec' END], lambda x: x IS NOT NULL)), ',') AS techniques FROM m, f "
    "WHERE NOT (whole AND m & 4 > 0)) SELECT techniques FROM t"
)


def _techniques_text(combos):
    return combos.select(F.array_join(F.array_sort("techniques"), ",").alias("techniques"))


@query("combos_lineitem", _ALL_COMBOS)
def combos_lineitem(spark, sf):
    """Column types after narrowing decide which techniques, hence combinations, exist."""
    lines = narrow_types(table(spark, sf, "lineitem").select(*LINE_QI))
    return _techniques_text(combinations_frame(spark, technique_combinations(eligible_techniques(lines))))


_PRUNED = (
    "WITH q AS (SELECT count(*) AS n, count(DISTINCT p_brand) AS a, count(DISTINCT p_type) AS b, count(DISTINCT p_size) AS c, count(DISTINCT p_retailprice) AS d FROM part), "
    "o AS (SELECT a > 0.7e0 * n OR b > 0.7e0 * n OR c > 0.7e0 * n OR d > 0.7e0 * n AS sup FROM q), "
    f"rc AS ({_ROUND_CANDIDATES}), rb AS (SELECT min(parameter) AS b FROM rc WHERE risk = (SELECT min(risk) FROM rc)), "
    "ro AS (SELECT bool_or(p_size <> trunc(round_even(p_size / b, 0) * b) OR p_retailprice <> round_even(p_retailprice / b, 0) * b) AS round FROM part, rb), "
    "st AS (SELECT trunc(0.5e0 * stddev_pop(p_size)) AS w FROM part), m AS (SELECT range AS m FROM range(1, 16)) "
    "SELECT array_to_string(list_sort(list_filter([CASE WHEN m & 1 > 0 THEN 'sup' END, "
    "CASE WHEN m & 4 > 0 THEN 'round' END, CASE WHEN m & 8 > 0 THEN 'globalrec' END], lambda x: x IS NOT NULL)), ',') AS techniques "
    "FROM m, o, ro, st WHERE (m & 1 = 0 OR sup) AND m & 2 = 0 AND (m & 4 = 0 OR round) AND (m & 8 = 0 OR w > 0)"
)


@query("pruned_combos_part", _PRUNED)
def pruned_combos_part(spark, sf):
    """Suppression changes nothing here, so every combination with it goes."""
    part = table(spark, sf, "part").select("p_partkey", *PART)
    study = study_of(part, PART, ["p_partkey"], min_score=3, seed=FIXED_SEED)
    left = surviving_combinations(part, study, ["sup", "round", "globalrec"])
    return _techniques_text(left)


def _risk_table_sql() -> str:
    """Rounding, recoding, and recoding after rounding, each searched as in the study."""
    fk = "(SELECT 100e0 * coalesce(sum(n) FILTER (n = 1), 0) / sum(n) FROM (SELECT count(*) AS n FROM {t} GROUP BY " + PART_COLS + "))"

    def recoded(name: str, source: str) -> str:
        best = (
            f"{name}_w AS (SELECT widths[1] AS w, (SELECT min(p_size) FROM {source}) AS low FROM "
            f"({_recode_candidates(source, {'p_size': 'p_size::BIGINT'}, ['p_brand', 'p_type'])}) ORDER BY fk, candidate LIMIT 1)"
        )
        return (
            f"{best}, {name} AS (SELECT p_partkey, p_brand, p_type, ({duck.recode('p_size', 'low', 'w')})::INTEGER AS p_size, "
            f"p_retailprice FROM {source}, {name}_w)"
        )

    chosen = " UNION ALL ".join(
        f"SELECT * FROM ({_rounded_part(b)}) WHERE {b!r} = (SELECT b FROM rb)" for b in (0.2, 5.0, 10.0)
    )
    scored = []
    for i, name, comb, techniques in ((0, "v_r", "R", "round"), (1, "v_g", "G", "globalrec"), (2, "v_rg", "G, R", "round,globalrec")):
        ctes = duck.searched_rl(f"{name}_s", name, "part", PART_FIELDS, 3, "p_partkey")
        scored.append(
            f"SELECT 0 AS ds_id, '{comb}' AS comb, round({fk.format(t='part')}, 6) AS initial_fk, round({fk.format(t=name)}, 6) AS fk, "
            f"round(risk, 6) AS rl, round(100e0 * abs(risk - {fk.format(t='part')}) / nullif({fk.format(t='part')}, 0), 6) AS diff, 'ok' AS status "
            f"FROM (WITH {ctes} SELECT * FROM {name}_s_rl)"
        )
    return (
        f"WITH rc AS ({_ROUND_CANDIDATES}), rb AS (SELECT min(parameter) AS b FROM rc WHERE risk = (SELECT min(risk) FROM rc)), "
        f"v_r AS MATERIALIZED ({chosen}), {recoded('v_g', 'part')}, {recoded('v_rg', 'v_r')} "
        f"{' UNION ALL '.join(scored)} UNION ALL SELECT 0, 'O', round({fk.format(t='part')}, 6), NULL, NULL, NULL, 'original'"
    )


@query("risk_table_part", _risk_table_sql())
def risk_table_part(spark, sf):
    """The whole study: search, apply, score and report every combination."""
    part = table(spark, sf, "part").select("p_partkey", *PART)
    study = study_of(part, PART, ["p_partkey"], min_score=3, seed=FIXED_SEED)
    done = evaluate(part, study, ["round", "globalrec"])
    return rounded(risk_report(done.risk), "initial_fk", "fk", "rl", "diff")
