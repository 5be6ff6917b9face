"""What the physical plans may and may not contain."""

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from veilspark.operators import linkage
from veilspark.operators.rounding import fit_rounding

NATIVE = [
    "fk_lineitem", "class_sizes_lineitem", "rl_part_rounded", "rl_full_index_supplier", "linkage_pairs_part",
    "laplace_part", "recode_part", "topbottom_events", "round_base_orders", "suppress_customer", "perf_pctdiff",
    "risk_mean_rank", "max_privacy_performance", "sign_test_priv", "folds_stratified", "best_rows_with_draws",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_product(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    for word in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_keyed_linkage_has_no_cross_product(spark, part, monkeypatch):
    monkeypatch.setattr(linkage, "DIRECT_BLOCK", 0)
    protected = fit_rounding(part, ["p_retailprice"], 5).transform(part)
    fields = ["p_brand", "p_type", "p_size", "p_retailprice"]
    plan = plan_of(linkage.linkage_risk(protected, part, fields, "p_size", 3))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(entry.queries()["fk_lineitem"](spark, SMALL))
    scan = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "l_orderkey" not in scan and "l_quantity" in scan


@pytest.mark.parametrize("name", ["class_sizes_lineitem", "laplace_part", "best_rows_with_draws", "max_privacy_performance"])
def test_no_window_over_data_groups(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL)).split("== Physical Plan ==")[1]
    assert "Window [" not in plan


def test_whole_grids_and_all_learners(spark, monkeypatch):
    from veilspark.catalog import modelling
    from veilspark.plans import modeling

    assert {m: len(modeling.grid(m)) for m in modeling.FULL_GRIDS} == {"RF": 12, "Bag": 3, "XGB": 36, "LogR": 6, "NN": 42}
    searched, fits = [], []
    small = {m: modeling.grid(m, "quick")[:1] for m in modeling.FULL_GRIDS}
    small["NN"] = [{"layout": 1, "alpha": a, "iterations": 5} for a in (5e-3, 1e-3, 1e-4)]
    make = modeling.estimator
    monkeypatch.setattr(modeling, "grid", lambda m, size="full": (searched.append((m, size)), small[m])[1])
    monkeypatch.setattr(modeling, "estimator", lambda m, *a: (fits.append(m), make(m, *a))[1])
    held = modelling.cv_holdout(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.model for r in held) == sorted(small)
    assert sorted(searched) == sorted((m, "full") for m in small)
    assert fits.count("NN") == 5 + 1
