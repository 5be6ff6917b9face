"""Queries on risk tables, combinations and cross-validation results."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog import duck
from veilspark.catalog.base import (
    DUCK_COMPLETE,
    DUCK_VIEWS,
    combos_view,
    duck_compared,
    perf_base_view,
    perf_view,
    query,
    risk_view,
    rounded,
)
from veilspark.functions.expressions import (
    MODEL_NAMES,
    compact_solution,
    dataset_number,
    display_model,
    solution_name,
    technique_initials,
)
from veilspark.plans import reports
from veilspark.plans.reports import COMPARISONS, solution_names
from veilspark.sources.tables import merge_batches

WITH = f"WITH {DUCK_VIEWS}, {DUCK_COMPLETE}"
SHORT_NAMES = solution_names("")
METRIC_COLUMNS = ["mean_test_bal_acc", "mean_test_gmean", "mean_test_f1_weighted"]
F1 = "mean_test_f1_weighted"


def _complete(spark, sf):
    return reports.complete_datasets(combos_view(spark, sf))


def _model_case(col: str) -> str:
    return f"CASE {col} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MODEL_NAMES.items())} ELSE {col} END"


def _int(x: str) -> str:
    return f"trunc({x})::INTEGER"


# --- combinations ---------------------------------------------------------------------


@query("complete_datasets", f"{WITH} SELECT ds_id FROM full_v")
def complete_datasets(spark, sf):
    return _complete(spark, sf)


@query(
    "variant_totals",
    f"{WITH}, c AS (SELECT ds_id, count(DISTINCT variant_id) AS v, count(DISTINCT solution) AS s FROM combos_v GROUP BY ds_id) "
    "SELECT sum(v)::BIGINT AS variants, sum(s)::BIGINT AS combinations, count(*) FILTER (v = 31)::BIGINT AS complete FROM c",
)
def variant_totals(spark, sf):
    return reports.variant_totals(combos_view(spark, sf))


@query(
    "venn_regions",
    f"{WITH} SELECT array_to_string(list_sort(string_split(solution, ', ')), ', ') AS region, count(DISTINCT ds_id)::BIGINT AS datasets "
    "FROM combos_v GROUP BY 1",
)
def venn_regions(spark, sf):
    return reports.venn_regions(combos_view(spark, sf))


@query(
    "technique_totals",
    f"{WITH}, t AS (SELECT ds_id, variant_id, unnest(string_split(solution, ', ')) AS technique FROM combos_v) "
    "SELECT technique, count(*)::BIGINT AS variants, count(DISTINCT ds_id)::BIGINT AS datasets FROM t GROUP BY technique",
)
def technique_totals(spark, sf):
    return reports.technique_totals(combos_view(spark, sf))


@query(
    "comb_initials",
    f"{WITH} SELECT ds_id, variant_id, solution AS comb, replace(solution, ', ', '') AS compact, "
    "len(string_split(solution, ', '))::INTEGER AS size FROM combos_v",
)
def comb_initials(spark, sf):
    """Technique names to initials to the canonical name, starting from unsorted names."""
    back = F.create_map(*[F.lit(x) for k, v in reports.INITIALS.items() for x in (v, k)])
    combos = combos_view(spark, sf)
    named = combos.withColumn("full", F.reverse(F.transform("techniques", lambda t: back[t])))
    comb = solution_name(technique_initials(F.col("full")))
    return named.select(
        "ds_id", "variant_id", comb.alias("comb"), compact_solution(comb).alias("compact"), F.size("full").alias("size")
    )


@query(
    "set_operations_combos",
    f"{WITH}, c AS (SELECT ds_id, variant_id, string_split(solution, ', ') AS t FROM combos_v) "
    "SELECT ds_id, variant_id, array_to_string(list_sort(list_distinct(list_concat(t, ['G', 'S']))), ',') AS with_both, "
    "array_to_string(list_sort(list_filter(t, lambda x: x <> 'G' AND x <> 'S')), ',') AS without_both, "
    "list_has_any(t, ['G', 'S']) AS has_any FROM c",
)
def set_operations_combos(spark, sf):
    some = F.array(F.lit("G"), F.lit("S"))
    return combos_view(spark, sf).select(
        "ds_id",
        "variant_id",
        F.array_join(F.array_sort(F.array_union("techniques", some)), ",").alias("with_both"),
        F.array_join(F.array_sort(F.array_except("techniques", some)), ",").alias("without_both"),
        F.arrays_overlap("techniques", some).alias("has_any"),
    )


@query(
    "comb_order",
    f"{WITH}, s AS (SELECT DISTINCT solution FROM combos_v UNION ALL SELECT 'O') "
    "SELECT solution, row_number() OVER (ORDER BY length(solution), lower(solution))::INTEGER AS ord FROM s",
)
def comb_order(spark, sf):
    names = combos_view(spark, sf).select("solution").distinct()
    originals = names.limit(1).select(F.lit("O").alias("solution"))
    return reports.in_solution_order(names.unionByName(originals), "solution")


@query(
    "comb_top5",
    f"{WITH}, m AS (SELECT comb, round(avg(rl), 6) AS rl FROM risk_v GROUP BY comb "
    "UNION ALL SELECT 'O', round(avg(initial_fk), 6) FROM risk_v) "
    "SELECT comb, rl FROM m ORDER BY length(comb), lower(comb) LIMIT 5",
)
def comb_top5(spark, sf):
    risk = risk_view(spark, sf)
    means = risk.groupBy("comb").agg(F.avg("rl").alias("rl"))
    means = means.unionByName(risk.agg(F.lit("O").alias("comb"), F.avg("initial_fk").alias("rl")))
    top = reports.in_solution_order(means, "comb").orderBy("ord").limit(5)
    return rounded(top.drop("ord"), "rl")


# --- risk -----------------------------------------------------------------------------


@query(
    "risk_pctdiff",
    f"{WITH} SELECT ds_id, comb, initial_fk, fk, rl, round(100e0 * abs(rl - initial_fk) / nullif(initial_fk, 0), 6) AS diff, "
    f"{_int('100e0 * abs(rl - initial_fk) / nullif(initial_fk, 0)')} AS diff_int FROM risk_v",
)
def risk_pctdiff(spark, sf):
    rows = reports.risk_differences(risk_view(spark, sf)).drop("variant_id")
    return rounded(rows.withColumn("diff_int", F.col("diff").cast("int")), "diff")


_DIFF_INT = _int("100e0 * abs(rl - initial_fk) / nullif(initial_fk, 0)")


@query(
    "risk_pivot",
    f"{WITH} SELECT ds_id, "
    + ", ".join(f"max({_DIFF_INT}) FILTER (comb = '{c}') AS \"{c}\"" for c in solution_names())
    + " FROM risk_v GROUP BY ds_id",
)
def risk_pivot(spark, sf):
    return reports.risk_pivot(risk_view(spark, sf))


@query("risk_pivot_original", f"{WITH} SELECT ds_id, {_int('max(initial_fk)')} AS \"O\" FROM risk_v GROUP BY ds_id")
def risk_pivot_original(spark, sf):
    return reports.original_pivot(risk_view(spark, sf))


_MEANS = (
    f"{WITH}, {duck_compared('r2', 'risk_v')}, m AS (SELECT comb, comparison, round(avg(rl), 9) AS rl FROM r2 GROUP BY ALL), "
    "k AS (SELECT comb, comparison, rl, trunc(rank() OVER (PARTITION BY comparison ORDER BY rl) "
    "+ (count(*) OVER (PARTITION BY comparison, rl) - 1) / 2e0)::INTEGER AS rank FROM m)"
)


@query("risk_mean_rank", f"{_MEANS} SELECT comb, comparison, round(rl, 6) AS rl, rank FROM k")
def risk_mean_rank(spark, sf):
    return rounded(reports.risk_means(risk_view(spark, sf), _complete(spark, sf)), "rl")


@query(
    "risk_rank_pivot",
    f"{_MEANS} SELECT comb, max(rank) FILTER (comparison = '18 datasets')::DOUBLE AS \"18 datasets\", "
    "max(rank) FILTER (comparison = 'All datasets')::DOUBLE AS \"All datasets\" FROM k GROUP BY comb",
)
def risk_rank_pivot(spark, sf):
    means = reports.risk_means(risk_view(spark, sf), _complete(spark, sf))
    return reports.rank_pivot(means, "comb", "comparison", COMPARISONS)


@query(
    "risk_rank_transposed",
    f"{_MEANS} SELECT comparison, "
    + ", ".join(f"max(rank) FILTER (comb = '{c}')::DOUBLE AS \"{c}\"" for c in solution_names())
    + " FROM k GROUP BY comparison",
)
def risk_rank_transposed(spark, sf):
    means = reports.risk_means(risk_view(spark, sf), _complete(spark, sf))
    return reports.rank_pivot(means, "comparison", "comb", solution_names())


@query(
    "risk_describe",
    f"{_MEANS}, d AS (SELECT count(rl)::DOUBLE AS c, avg(rl) AS m, stddev_samp(rl) AS s, min(rl) AS lo, max(rl) AS hi, "
    "quantile_cont(rl, 0.25) AS a, quantile_cont(rl, 0.5) AS b, quantile_cont(rl, 0.75) AS q FROM k) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS statistic, round({c}, 6) AS value FROM d"
        for n, c in (("count", "c"), ("mean", "m"), ("std", "s"), ("min", "lo"), ("max", "hi"), ("25%", "a"), ("50%", "b"), ("75%", "q"))
    ),
)
def risk_describe(spark, sf):
    means = reports.risk_means(risk_view(spark, sf), _complete(spark, sf))
    return rounded(reports.summary(means, "rl"), "value")


_DIFFS = f"{WITH}, {duck_compared('r2', 'risk_v')}, d AS (SELECT *, 100e0 * abs(rl - initial_fk) / nullif(initial_fk, 0) AS diff FROM r2)"


@query(
    "risk_bar_means",
    f"{_DIFFS}, s AS (SELECT comb, comparison, count(diff) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd FROM d WHERE diff IS NOT NULL GROUP BY ALL) "
    "SELECT comb, comparison, n::BIGINT AS n, round(mean, 6) AS mean, round(mean - 1.959963984540054e0 * sd / sqrt(n::DOUBLE), 6) AS low, "
    "round(mean + 1.959963984540054e0 * sd / sqrt(n::DOUBLE), 6) AS high FROM s",
)
def risk_bar_means(spark, sf):
    return rounded(reports.bar_means(risk_view(spark, sf), _complete(spark, sf)), "mean", "low", "high")


_CUMULATIVE = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402,
)
_POISSON = "CASE " + " ".join(f"WHEN u + 0.5e0 < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(_CUMULATIVE)) + " ELSE 9 END"


@query(
    "risk_bootstrap_means",
    f"{_DIFFS}, b AS (SELECT d.*, replicate FROM d, (SELECT unnest(range(1, 101)) AS replicate) WHERE diff IS NOT NULL), "
    f"u AS (SELECT *, {duck.uniform('boot', 'replicate', 'comparison', 'ds_id', 'variant_id')} AS u FROM b), w AS (SELECT *, {_POISSON} AS w FROM u) "
    "SELECT comb, comparison, replicate::INTEGER AS replicate, round(sum(w * diff) / nullif(sum(w), 0), 6) AS mean FROM w GROUP BY ALL",
)
def risk_bootstrap_means(spark, sf):
    found = reports.bootstrap_means(risk_view(spark, sf), _complete(spark, sf), ["ds_id", "variant_id"], "boot")
    return rounded(found, "mean")


@query(
    "zero_risk_rows",
    f"{WITH} SELECT ds_id, comb, rl FROM risk_v WHERE rl = 0 AND ds_id IN (SELECT ds_id FROM full_v)",
)
def zero_risk_rows(spark, sf):
    return reports.zero_risk(risk_view(spark, sf), _complete(spark, sf))


# --- risk against performance ---------------------------------------------------------

_PD = (
    f"{WITH}, pb AS (SELECT ds_id, model, max({F1}) AS base FROM perf_base_v GROUP BY ALL), "
    f"pd AS (SELECT p.*, 100e0 * (p.{F1} - base) / nullif(base, 0) AS pd FROM perf_v p JOIN pb USING (ds_id, model))"
)


def _differences(spark, sf):
    return reports.performance_differences(perf_view(spark, sf), perf_base_view(spark, sf))


@query(
    "max_privacy_performance",
    f"{_PD}, z AS (SELECT ds_id, comb FROM risk_v WHERE rl = 0 AND ds_id IN (SELECT ds_id FROM full_v)), "
    "j AS (SELECT pd.* FROM pd LEFT JOIN z ON pd.ds_id = z.ds_id AND pd.solution = z.comb WHERE z.comb IS NOT NULL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY model, ds_id, solution ORDER BY pd DESC, l_orderkey, l_linenumber) AS rn FROM j) "
    f"SELECT {_model_case('model')} AS model, ds_id, solution, round(pd, 6) AS perdif, l_orderkey, l_linenumber FROM r WHERE rn = 1",
)
def max_privacy_performance(spark, sf):
    perf = _differences(spark, sf).withColumn("ds_id", dataset_number(F.col("ds")))
    value = f"{F1}_perdif"
    best = reports.best_private_performance(
        perf, risk_view(spark, sf), _complete(spark, sf), value, ["l_orderkey", "l_linenumber"]
    )
    return rounded(best.withColumnRenamed(value, "perdif"), "perdif")


@query(
    "best_rows_with_draws",
    f"{WITH} SELECT l_orderkey, l_linenumber, model, ds_id, solution, {F1} FROM "
    f"(SELECT *, max({F1}) OVER (PARTITION BY model, ds_id, solution) AS m FROM perf_v) WHERE {F1} = m",
)
def best_rows_with_draws(spark, sf):
    perf = perf_view(spark, sf).select("l_orderkey", "l_linenumber", "model", "ds_id", "solution", F1)
    return reports.at_group_maximum(perf, ["model", "ds_id", "solution"], F1)


# --- performance ----------------------------------------------------------------------


@query(
    "perf_baseline",
    f"{WITH} SELECT ds_id, model, max({F1}) AS base_f1_weighted FROM perf_base_v GROUP BY ALL",
)
def perf_baseline(spark, sf):
    return reports.baselines(perf_base_view(spark, sf))


@query(
    "perf_pctdiff",
    f"{_PD} SELECT l_orderkey, l_linenumber, ds_id, model, round(pd, 6) AS perdif FROM pd",
)
def perf_pctdiff(spark, sf):
    found = _differences(spark, sf).withColumnRenamed(f"{F1}_perdif", "perdif")
    return rounded(found.select("l_orderkey", "l_linenumber", "ds_id", "model", "perdif"), "perdif")


@query(
    "perf_is_original",
    f"{WITH}, u AS (SELECT concat('ds', ds_id) AS ds, model FROM perf_base_v UNION ALL SELECT ds, model FROM perf_v) "
    "SELECT NOT contains(ds, '_') AS is_original, count(*)::BIGINT AS n, count(DISTINCT ds)::BIGINT AS names FROM u GROUP BY 1",
)
def perf_is_original(spark, sf):
    originals = perf_base_view(spark, sf).select(F.concat(F.lit("ds"), F.col("ds_id").cast("string")).alias("ds"), "model")
    rows = originals.unionByName(perf_view(spark, sf).select("ds", "model"))
    marked = rows.groupBy(reports.is_original(F.col("ds")).alias("is_original"), "ds").agg(F.count(F.lit(1)).alias("n"))
    return marked.groupBy("is_original").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names"))


@query(
    "perf_melt",
    f"{WITH}, m AS (UNPIVOT (SELECT model, solution, {', '.join(METRIC_COLUMNS)} FROM perf_v) ON {', '.join(METRIC_COLUMNS)} INTO NAME metrics VALUE values) "
    "SELECT model, solution, metrics, count(*)::BIGINT AS n, round(sum(\"values\"), 4) AS total FROM m GROUP BY ALL",
)
def perf_melt(spark, sf):
    long = reports.melt_metrics(perf_view(spark, sf), ["model", "solution"], METRIC_COLUMNS)
    sums = long.groupBy("model", "solution", "metrics").agg(
        F.count(F.lit(1)).alias("n"), F.sum("values").alias("total")
    )
    return rounded(sums, "total", digits=4)


def _box_sql(source: str, groups: str, value: str) -> str:
    return (
        f"q AS (SELECT {groups}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY {groups}), "
        f"w AS (SELECT s.*, q1, median, q3, {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {source} s JOIN q USING ({groups})) "
        f"SELECT {groups}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*)::BIGINT AS n, "
        f"round(min({value}) FILTER (inside), 6) AS whisker_low, round(max({value}) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside)::BIGINT AS outliers "
        f"FROM w GROUP BY {groups}, q1, median, q3"
    )


_BOX_COLUMNS = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "perf_box",
    f"{WITH}, m AS (UNPIVOT (SELECT model, {', '.join(METRIC_COLUMNS)} FROM perf_v) ON {', '.join(METRIC_COLUMNS)} INTO NAME metrics VALUE v), "
    + _box_sql("m", "model, metrics", "v"),
)
def perf_box(spark, sf):
    long = reports.melt_metrics(perf_view(spark, sf), ["model"], METRIC_COLUMNS)
    return rounded(reports.box_statistics(long, ["model", "metrics"], "values"), *_BOX_COLUMNS)


@query(
    "perf_box_comparison",
    f"{_PD}, {duck_compared('c', 'pd')}, " + _box_sql("c", "solution, comparison", "pd"),
)
def perf_box_comparison(spark, sf):
    rows = reports.with_comparison(_differences(spark, sf), _complete(spark, sf))
    found = reports.box_statistics(rows, ["solution", "comparison"], f"{F1}_perdif", method="bracket")
    return rounded(found, *_BOX_COLUMNS)


def _rank_sql(inner: str) -> str:
    return (
        f"m AS (SELECT model, solution, comparison, round(avg(x), 9) AS x FROM ({inner}) GROUP BY ALL), "
        "k AS (SELECT *, trunc(rank() OVER (PARTITION BY model, comparison ORDER BY x DESC) + (count(*) OVER (PARTITION BY model, comparison, x) - 1) / 2e0)::INTEGER AS rank FROM m)"
    )


_PERF_RANKS = f"{WITH}, {duck_compared('c', 'perf_v')}, " + _rank_sql(f"SELECT *, {F1} AS x FROM c")
_PERF_RANKS_MAX = f"{WITH}, {duck_compared('c', 'perf_v')}, " + _rank_sql(
    f"SELECT ds_id, model, solution, comparison, max({F1}) AS x FROM c GROUP BY ALL"
)


@query(
    "perf_rank",
    f"{_PERF_RANKS} SELECT {_model_case('model')} AS model, solution, comparison, round(x, 6) AS {F1}, rank FROM k",
)
def perf_rank(spark, sf):
    return rounded(reports.performance_ranks(perf_view(spark, sf), _complete(spark, sf), F1), F1)


@query(
    "perf_rank_best_first",
    f"{_PERF_RANKS_MAX} SELECT {_model_case('model')} AS model, solution, comparison, round(x, 6) AS {F1}, rank FROM k",
)
def perf_rank_best_first(spark, sf):
    return rounded(reports.performance_ranks(perf_view(spark, sf), _complete(spark, sf), F1, True), F1)


@query(
    "perf_rank_pivot",
    f"{_PERF_RANKS} SELECT {_model_case('model')} AS model, comparison, "
    + ", ".join(f"max(rank) FILTER (replace(solution, ', ', '') = '{c}')::DOUBLE AS \"{c}\"" for c in SHORT_NAMES)
    + " FROM k GROUP BY 1, 2",
)
def perf_rank_pivot(spark, sf):
    ranks = reports.performance_ranks(perf_view(spark, sf), _complete(spark, sf), F1)
    ranks = ranks.withColumn("solution", compact_solution(F.col("solution")))
    return reports.rank_pivot(ranks, "comparison", "solution", SHORT_NAMES, ["model"])


@query(
    "perf_by_solution",
    f"{WITH} SELECT replace(c.solution, ', ', '') AS solution, p.model, count(*)::BIGINT AS n, max({F1}) AS best, round(sum({F1}::DECIMAL(18, 6))::DOUBLE / count(*), 6) AS mean "
    "FROM perf_v p JOIN combos_v c USING (ds_id, variant_id) GROUP BY 1, 2",
)
def perf_by_solution(spark, sf):
    rows = reports.by_solution(perf_view(spark, sf), combos_view(spark, sf))
    stats = rows.groupBy("solution", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F1).alias("best"),
        # A decimal sum is exact, so the mean does not depend on the order of the rows.
        (F.sum(F.col(F1).cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias("mean"),
    )
    return rounded(stats, "mean")


@query(
    "perf_one_combination",
    f"{WITH} SELECT l_orderkey, l_linenumber, ds, model, {F1} FROM perf_v p JOIN combos_v c USING (ds_id, variant_id) "
    "WHERE list_sort(string_split(c.solution, ', ')) = ['G', 'N', 'T'] AND ds_id IN (SELECT ds_id FROM full_v)",
)
def perf_one_combination(spark, sf):
    """Exactly this set of techniques, on complete datasets only."""
    wanted = solution_name(F.array(F.lit("T"), F.lit("N"), F.lit("G")))
    combos = combos_view(spark, sf)
    exact = combos.where(solution_name(F.col("techniques")) == wanted).join(_complete(spark, sf), "ds_id", "left_semi")
    rows = perf_view(spark, sf).join(exact.select("ds_id", "variant_id"), ["ds_id", "variant_id"])
    return rows.select("l_orderkey", "l_linenumber", "ds", "model", F1)


@query(
    "perf_model_names",
    f"{WITH} SELECT {_model_case('model')} AS model, count(*)::BIGINT AS n FROM perf_v GROUP BY 1",
)
def perf_model_names(spark, sf):
    counts = perf_view(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("model", display_model(F.col("model")))


@query(
    "perf_dataset_numbers",
    f"{WITH} SELECT regexp_extract(string_split(ds, '_')[1], '[0-9]+')::INTEGER AS number, count(*)::BIGINT AS n FROM perf_v GROUP BY 1",
)
def perf_dataset_numbers(spark, sf):
    return perf_view(spark, sf).groupBy(dataset_number(F.col("ds")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "perf_concat_reps",
    f"{WITH} SELECT ds, model, rep, count(*)::BIGINT AS n, max({F1}) AS best FROM perf_v GROUP BY ALL",
)
def perf_concat_reps(spark, sf):
    """Five batches of results, one per repetition, merged into one table again."""
    perf = perf_view(spark, sf)
    batches = [reports.repetitions_of(perf, [r]) for r in range(5)]
    merged = batches[0]
    for b in batches[1:]:
        merged = merged.unionByName(b)
    return merged.groupBy("ds", "model", "rep").agg(F.count(F.lit(1)).alias("n"), F.max(F1).alias("best"))


@query(
    "union_batches",
    f"{WITH} SELECT ds_id, variant_id, comb, initial_fk, fk, rl FROM risk_v",
)
def union_batches(spark, sf):
    """Overlapping batches of a risk table: rows that two batches hold stay once."""
    risk = risk_view(spark, sf)
    low, high = risk.where("ds_id < 12"), risk.where("ds_id >= 8")
    return merge_batches([low, high], ["ds_id", "variant_id"])
