"""Queries on the Bayesian comparison of combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog.analysis import F1, _PD, _differences
from veilspark.catalog.base import perf_view, query, risk_view, rounded
from veilspark.functions.expressions import compact_solution
from veilspark.plans import bayes

PERDIF = f"{F1}_perdif"


def _test(source: str, value: str, name: str = "t", key: str = "solution") -> str:
    """Best per dataset and combination, then the exact posterior means."""
    return (
        f"{name}_m AS (SELECT ds_id, replace(solution, ', ', '') AS solution, max({value}) AS x FROM {source} WHERE {value} IS NOT NULL GROUP BY ds_id, solution), "
        f"{name}_a AS (SELECT {key}, avg((x < -1)::INT) + 0.0001e0 AS a, avg((x > -1 AND x < 1)::INT) + 0.0001e0 AS b, avg((x > 1)::INT) + 0.0001e0 AS c FROM {name}_m GROUP BY {key}), "
        f"{name} AS (SELECT {key}, a / (a + b + c) AS lose, b / (a + b + c) AS draw, c / (a + b + c) AS win FROM {name}_a)"
    )


def _long(name: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT solution, '{label}' AS result, round({c}, 6) AS probability{extra} FROM {name}"
        for label, c in (("Lose", "lose"), ("Draw", "draw"), ("Win", "win"))
    )


@query("sign_test", f"{_PD}, {_test('pd', 'pd')} SELECT solution, round(lose, 6) AS lose, round(draw, 6) AS draw, round(win, 6) AS win FROM t")
def sign_test(spark, sf):
    best = bayes.best_per_solution(_differences(spark, sf), PERDIF)
    named = best.withColumn("solution", compact_solution(F.col("solution")))
    return rounded(bayes.sign_test(named, PERDIF), "lose", "draw", "win")


@query(
    "sign_test_proportions",
    f"{_PD} SELECT solution, round(avg((pd < -1)::INT), 6) AS \"left\", round(avg((pd > -1 AND pd < 1)::INT), 6) AS inside, "
    "round(avg((pd > 1)::INT), 6) AS \"right\", count(*)::BIGINT AS n FROM pd GROUP BY solution",
)
def sign_test_proportions(spark, sf):
    return rounded(bayes.proportions(_differences(spark, sf), PERDIF), "left", "inside", "right")


@query("sign_test_long", f"{_PD}, {_test('pd', 'pd')} {_long('t')}")
def sign_test_long(spark, sf):
    return rounded(bayes.test_solutions(_differences(spark, sf), PERDIF), "probability")


_BEST = (
    f"{_PD}, bb AS (SELECT ds_id, model, max({F1}) AS top FROM perf_v GROUP BY ALL), "
    f"bs AS (SELECT p.*, 100e0 * ({F1} - top) / nullif(top, 0) AS v FROM perf_v p JOIN bb USING (ds_id, model))"
)
_PRIVATE = (
    f"{_PD}, lr AS (SELECT ds_id, min(rl) AS least FROM risk_v GROUP BY ds_id), "
    "lp AS (SELECT DISTINCT ds_id, comb AS solution FROM risk_v JOIN lr USING (ds_id) WHERE rl = least), "
    f"pb2 AS (SELECT ds_id, model, max({F1}) AS top FROM perf_v JOIN lp USING (ds_id, solution) GROUP BY ALL), "
    f"ps AS (SELECT p.*, 100e0 * ({F1} - top) / nullif(top, 0) AS v FROM perf_v p JOIN pb2 USING (ds_id, model))"
)


@query("sign_test_bestsol", f"{_BEST}, {_test('bs', 'v')} {_long('t')}")
def sign_test_bestsol(spark, sf):
    perf = bayes.against_best_solution(perf_view(spark, sf), F1, "v")
    return rounded(bayes.test_solutions(perf, "v"), "probability")


@query("sign_test_priv", f"{_PRIVATE}, {_test('ps', 'v')} {_long('t')}")
def sign_test_priv(spark, sf):
    perf = bayes.against_best_private(perf_view(spark, sf), risk_view(spark, sf), F1, "v")
    return rounded(bayes.test_solutions(perf, "v"), "probability")


_TWO = (
    f"{_PD}, one AS (SELECT * FROM pd WHERE rep = 0), {_test('pd', 'pd', 'a')}, {_test('one', 'pd', 'b')}, "
    f"u AS ({_long('a', ', ' + chr(39) + 'all repetitions' + chr(39) + ' AS source')} UNION ALL "
    f"{_long('b', ', ' + chr(39) + 'one repetition' + chr(39) + ' AS source')})"
)


def _two_sources(spark, sf):
    perf = _differences(spark, sf)
    both = bayes.test_solutions(perf, PERDIF, "all repetitions").unionByName(
        bayes.test_solutions(perf.where("rep = 0"), PERDIF, "one repetition")
    )
    return rounded(both, "probability")


@query("sign_test_compare", f"{_TWO} SELECT * FROM u WHERE probability > 0.0099")
def sign_test_compare(spark, sf):
    return bayes.visible(_two_sources(spark, sf))


@query(
    "sign_test_outcomes",
    f"{_TWO} SELECT source, count(DISTINCT result)::BIGINT AS outcomes FROM u WHERE probability > 0.0099 GROUP BY source",
)
def sign_test_outcomes(spark, sf):
    seen = bayes.visible(_two_sources(spark, sf))
    return seen.groupBy("source").agg(F.count_distinct("result").alias("outcomes"))


@query(
    "sign_test_totals",
    f"{_TWO} SELECT solution, result, round(sum(probability), 6) AS total FROM u GROUP BY solution, result",
)
def sign_test_totals(spark, sf):
    return rounded(bayes.outcome_totals(_two_sources(spark, sf)), "total")


@query(
    "sign_test_counts",
    f"{_PD}, c AS (SELECT solution, sum((pd < -1)::INT) + 0.0001e0 AS a, sum((pd > -1 AND pd < 1)::INT) + 0.0001e0 AS b, "
    "sum((pd > 1)::INT) + 0.0001e0 AS c FROM pd GROUP BY solution) SELECT solution, round(a / (a + b + c), 6) AS lose, "
    "round(b / (a + b + c), 6) AS draw, round(c / (a + b + c), 6) AS win FROM c",
)
def sign_test_counts(spark, sf):
    found = bayes.sign_test(_differences(spark, sf), PERDIF, counts=True)
    return rounded(found, "lose", "draw", "win")


@query("sign_test_mc")
def sign_test_mc(spark, sf):
    """Means of 30,000 Dirichlet draws per combination; rows only."""
    best = bayes.best_per_solution(_differences(spark, sf), PERDIF)
    named = best.withColumn("solution", compact_solution(F.col("solution")))
    return rounded(bayes.sign_test_draws(named, PERDIF), "lose", "draw", "win", digits=4)
