"""Hand-made tables with answers worked out by hand, and properties that must hold."""

import pytest
from pyspark.sql import functions as F
from veilspark.functions.expressions import hash_uniform, laplace_noise
from veilspark.operators.compare import tables_equal
from veilspark.operators.equivalence import cardinalities, class_counts, fk_value, pick_block, with_class_size
from veilspark.operators.equivalence import Cardinalities
from veilspark.operators.fences import fit_fences
from veilspark.operators.noise import fit_noise
from veilspark.operators.recoding import RecodingPolicy, fit_recoding
from veilspark.operators.rounding import fit_decimals, fit_rounding
from veilspark.operators.schema import eligible_techniques, integral_columns, narrow_types, technique_combinations
from veilspark.operators.search import search_recoding, search_rounding, search_suppression
from veilspark.operators.suppression import fit_suppression


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, x {kind}")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_class_sizes_with_nulls(spark):
    rows = [(1, "x"), (1, "x"), (1, "y"), (2, "x"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a int, b string")
    assert values(with_class_size(df, ["a", "b"]), "class_size") == [2, 2, 1, 1, 2, 2]
    assert fk_value(df, ["a", "b"]) == pytest.approx(33.333333, abs=1e-6)


def test_empty_table_has_no_fk(spark):
    assert fk_value(spark.createDataFrame([], "a int"), ["a"]) is None


@pytest.mark.parametrize(
    "distinct, expected",
    [((10, 6, 6, 2), "c1"), ((10, 9), "c1"), ((8, 8, 3), "c0"), ((10, 10), "c0")],
)
def test_block_choice(distinct, expected):
    stats = Cardinalities(10, {f"c{i}": d for i, d in enumerate(distinct)})
    assert pick_block(stats) == expected


def test_cardinalities_in_several_passes(spark):
    df = spark.range(50).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(20)])
    assert cardinalities(df).distinct == {f"c{i}": i + 1 for i in range(20)}


def test_fences(spark):
    df = column(spark, [1.0, 2.0, 3.0, 4.0, 100.0])
    policy = fit_fences(df, ["x"], 1.5)
    assert policy.fences["x"] == (-1.0, 7.0)
    assert values(policy.transform(df)) == [1.0, 2.0, 3.0, 4.0, 7.0]
    constant = column(spark, [5.0] * 4 + [None])
    assert values(fit_fences(constant, ["x"]).transform(constant)) == [5.0] * 4 + [None]


def test_integer_fence_is_cut_toward_zero(spark):
    df = column(spark, [-100, 1, 2, 3, 4, 100], "int")
    coded = fit_fences(df, ["x"], 0.5).transform(df)
    assert dict(coded.dtypes)["x"] == "int"
    low, high = fit_fences(df, ["x"], 0.5).fences["x"]
    assert values(coded)[0] == int(low) and values(coded)[-1] == int(high)


def test_rounding_halves(spark):
    df = column(spark, [2.5, 7.5, 12.5, -2.5, None])
    once = fit_rounding(df, ["x"], 5).transform(df)
    assert values(once) == [0.0, 10.0, 10.0, 0.0, None]
    assert values(fit_rounding(once, ["x"], 5).transform(once)) == values(once)


def test_round_decimals(spark):
    df = column(spark, [0.125, 0.375, 1.0])
    assert values(fit_decimals(df, digits=2).transform(df)) == [0.12, 0.38, 1.0]


def test_recoding(spark):
    df = column(spark, [*range(1, 11), None], "bigint")
    coded = fit_recoding(df, ["x"], widths={"x": 3}).transform(df)
    assert values(coded) == [1, 1, 1, 1, 4, 4, 4, 7, 7, 7, None]


def test_recoding_beyond_double_precision(spark):
    base = 2**60
    df = column(spark, [base, base + 1, base + 3, base + 4], "bigint")
    coded = RecodingPolicy({"x": (base, 3)}).transform(df)
    assert values(coded) == [base, base, base, base + 3]


def test_suppression_is_strict(spark):
    df = spark.createDataFrame([(i, i % 5, f"n{i}") for i in range(10)], "id int, half int, name string")
    assert fit_suppression(df, ["half", "name"], 0.5).columns == ("name",)
    assert fit_suppression(df, ["half", "name"], 0.49).columns == ("half", "name")
    out = fit_suppression(df, ["half"], 0.4).transform(df)
    assert {r["half"] for r in out.collect()} == {"*"}


def test_narrowing(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5, None, 1e300), (2.0, 2.0, 3.0, 2.0)], "a double, b double, c double, d double"
    )
    assert integral_columns(df) == ["a"]
    assert dict(narrow_types(df).dtypes)["a"] == "bigint"


def test_combinations(spark):
    df = spark.createDataFrame([(1, 1.0, "x")], "i int, f double, s string")
    assert eligible_techniques(df) == ["sup", "topbot", "noise", "round", "globalrec"]
    combos = technique_combinations(eligible_techniques(df))
    assert len(combos) == 31 and combos[0] == ("sup",) and combos[-1] == tuple(eligible_techniques(df))
    assert eligible_techniques(df, ["s"]) == ["sup"]


def test_fk_never_grows_by_recoding_or_suppression(part):
    qi = ["p_brand", "p_type", "p_size"]
    before = fk_value(part, qi)
    assert fk_value(fit_recoding(part, ["p_size"], 0.5).transform(part), qi) <= before
    assert fk_value(fit_suppression(part, ["p_size"], 0.1).transform(part), qi) <= before
    assert fk_value(part.repartition(7).orderBy(F.desc("p_partkey")), qi) == before


def test_noise_does_not_depend_on_partitions(part):
    def noisy(n):
        spread = part.repartition(n)
        policy = fit_noise(spread, ["p_partkey"], "s", ["p_retailprice"], ["p_brand"])
        return policy.transform(spread)

    assert tables_equal(noisy(1), noisy(16), ["p_partkey"]).first()["equal"]


def test_noise_distribution(spark):
    n, diam, eps = 40_000, 10.0, 2.0
    u = hash_uniform("s", F.col("id"))
    draws = spark.range(n).select(laplace_noise(u, F.lit(diam / eps)).alias("z"))
    row = draws.agg(F.avg("z").alias("m"), F.avg(F.abs("z")).alias("a")).first()
    assert abs(row["m"]) < 0.15 and row["a"] == pytest.approx(diam / eps, rel=0.03)


def test_noise_leaves_classes_without_spread(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0), (3, 2, 1.0), (4, 2, 9.0)], "id int, k int, x double")
    out = values(fit_noise(df, ["id"], "s", ["x"], ["k"]).transform(df))
    assert out[:2] == [5.0, 5.0] and out[2:] != [1.0, 9.0]


def test_noise_seed_is_not_shown(part):
    policy = fit_noise(part, ["p_partkey"], "very-secret", ["p_retailprice"], ["p_brand"])
    assert "very-secret" not in repr(policy)


def test_recoding_search_takes_first_minimum(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(41)], "a int, b int")
    found = search_recoding(df, ["a"], (0.2, 0.5))
    assert found.risks[0][1] == found.risks[1][1] == 0.0
    assert found.best == found.risks[0][0]


def test_recoding_search_tries_all_widths_in_passes(spark, monkeypatch):
    from veilspark.operators import search

    df = spark.createDataFrame([(i, i * 7 % 31, i * 5 % 17) for i in range(60)], "a int, b int, c int")
    whole = search_recoding(df, ["a", "b", "c"])
    monkeypatch.setattr(search, "CANDIDATES_PER_PASS", 3)
    assert len(whole.risks) == 8 and search_recoding(df, ["a", "b", "c"]).risks == whole.risks


def test_suppression_search_without_candidate(spark):
    df = spark.createDataFrame([(i % 2, "x") for i in range(10)], "a int, b string")
    found = search_suppression(df, df, ["a", "b"])
    assert found.policy is None and found.candidates == ()


def test_rounding_search_prefers_the_smallest_of_equals(spark):
    df = spark.createDataFrame([(i, 1, 10 * i) for i in range(6)], "id int, a int, b int")
    found = search_rounding(df, df, ["a", "b"], (5.0, 10.0))
    assert found.policy.base == 5.0


def test_class_counts_ignore_partitioning(part):
    qi = ["p_brand", "p_type"]
    one, many = class_counts(part.coalesce(1), qi), class_counts(part.repartition(9), qi)
    assert tables_equal(one, many).first()["equal"]
