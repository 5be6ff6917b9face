"""Quantiles, ranks, metrics, sign tests and the remaining plans on small tables."""

import pytest
from pyspark.sql import functions as F
from veilspark.functions.quantiles import quantiles
from veilspark.functions.ranking import average_rank, dense_codes, hashed_row_number
from veilspark.functions.relations import shared_folder
from veilspark.operators.compare import changed_values, tables_equal
from veilspark.operators.fences import fit_fences
from veilspark.operators.rounding import fit_rounding
from veilspark.plans import bayes, features, reports
from veilspark.plans.deidentify import apply_combination, evaluate, study_of
from veilspark.plans.metrics import confusion, metrics
from veilspark.plans.modeling import FULL_GRIDS, grid, hidden_layers
from veilspark.sources import tables
from veilspark.streaming.policies import protect_stream, run_available


def test_bracketed_quantiles_are_exact(spark):
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    df = spark.range(30_000).select(
        (F.col("id") % 3 == 0).alias("g"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 10_007) / 8.0).alias("x"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("y"),
    )
    direct = quantiles(df, ["x", "y"], probs, ["g"], "direct").orderBy("g").collect()
    for whole in (0, 100_000):
        bracket = quantiles(df, ["x", "y"], probs, ["g"], "bracket", whole_group=whole).orderBy("g").collect()
        for a, b in zip(direct, bracket):
            assert a["x"] == pytest.approx(b["x"]) and a["y"] == pytest.approx(b["y"])


def test_average_rank(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 1, 2, 3, 3, 3)], "g string, v int")
    ranked = df.withColumn("r", average_rank("v", ["g"]))
    assert sorted(r["r"] for r in ranked.collect()) == [1.5, 1.5, 3, 5, 5, 5]
    assert sorted(r["x"] for r in ranked.select(F.col("r").cast("int").alias("x")).collect()) == [1, 1, 3, 5, 5, 5]


def test_hashed_row_number_is_a_permutation(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4990, "b").alias("g"))
    rows = hashed_row_number(df.repartition(5), "g", ["id"], "s").collect()
    for g, n in (("hot", 4000), ("b", 990), (None, 10)):
        assert sorted(r["rn"] for r in rows if r["g"] == g) == list(range(1, n + 1))
        assert {r["rn_of"] for r in rows if r["g"] == g} == {n}
    again = hashed_row_number(df.coalesce(1), "g", ["id"], "s").collect()
    assert {(r["id"], r["rn"]) for r in rows} == {(r["id"], r["rn"]) for r in again}


def test_dense_codes_by_ranges(spark):
    df = spark.range(900).select(F.concat(F.lit("v"), F.col("id") % 300).alias("v"))
    plain = {r["v"]: r["code"] for r in dense_codes(df, "v").collect()}
    ranged = {r["v"]: r["code"] for r in dense_codes(df, "v", single_task_limit=10, buckets=7).collect()}
    assert plain == ranged == {v: i for i, v in enumerate(sorted(plain))}


def test_metrics(spark):
    rows = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] + [(0.0, 0.0)] * 2 + [(0.0, 1.0)] * 4
    df = spark.createDataFrame(rows, "label double, prediction double").withColumn("k", F.lit(1))
    m = metrics(confusion(df, ["k"]), ["k"]).first()
    assert m["acc"] == pytest.approx(0.5) and m["bal_acc"] == pytest.approx((3 / 4 + 2 / 6) / 2)
    assert m["gmean"] == pytest.approx((3 / 4 * 2 / 6) ** 0.5) and m["f1"] == pytest.approx(6 / 11)
    assert m["f1_weighted"] == pytest.approx(0.4 * 6 / 11 + 0.6 * 4 / 9)
    never = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label double, prediction double").withColumn("k", F.lit(1))
    m = metrics(confusion(never, ["k"]), ["k"]).first()
    assert m["gmean"] == 0.0 and m["f1"] == 0.0


def test_sign_test_bounds_are_strict(spark):
    df = spark.createDataFrame([("G", float(v)) for v in (-2, -1, 0, 1, 3)], "solution string, d double")
    row = bayes.sign_test(df, "d").first()
    assert row["lose"] == row["draw"] == row["win"] == pytest.approx(1 / 3)
    long = bayes.as_long(bayes.sign_test(df, "d"))
    assert sum(r["probability"] for r in long.collect()) == pytest.approx(1.0)


def test_drawn_probabilities_are_near_the_exact_ones(spark):
    rows = [(s, float(v)) for s, vs in (("G", (-5, -3, 0, 2)), ("N", (4, 5, 6, 0))) for v in vs]
    df = spark.createDataFrame(rows, "solution string, d double")
    exact = {r["solution"]: r for r in bayes.sign_test(df, "d").collect()}
    drawn = bayes.sign_test_draws(df, "d", draws=30_000).collect()
    again = bayes.sign_test_draws(df.repartition(4), "d", draws=30_000).collect()
    for r in drawn:
        for o in ("lose", "draw", "win"):
            assert r[o] == pytest.approx(exact[r["solution"]][o], abs=0.02)
    assert {r["solution"]: round(r["win"], 9) for r in drawn} == {r["solution"]: round(r["win"], 9) for r in again}


def test_grids_have_the_full_size():
    assert {m: len(grid(m, "full")) for m in FULL_GRIDS} == {"RF": 12, "Bag": 3, "XGB": 36, "LogR": 6, "NN": 42}
    assert hidden_layers(6, 9) == [9, 4, 6]


def test_solution_names():
    assert len(reports.solution_names()) == 31 and reports.solution_names()[5] == "G, N"


def test_split_and_folds_are_stratified(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    split = features.stratified_split(df, "y", ["id"], "s")
    sizes = {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert sizes[(1, True)] == round(0.2 * 144) and sizes[(0, True)] == round(0.2 * 859)
    folds = features.stratified_folds(df, "y", ["id"], "s").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in folds if r["y"] == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_study_on_parts(spark, part):
    fields = ["p_brand", "p_size", "p_retailprice"]
    study = study_of(part.select("p_partkey", *fields), None, ["p_partkey"], min_score=2, seed="s")
    assert study.qi == tuple(fields)
    done = evaluate(part.select("p_partkey", *fields), study, ["round", "globalrec"])
    rows = {tuple(r["techniques"]): r for r in done.risk.collect()}
    assert set(rows) == {("round",), ("globalrec",), ("round", "globalrec")} == set(done.variants)
    assert all(r["status"] == "ok" for r in rows.values())
    chained = apply_combination(part.select("p_partkey", *fields), ["globalrec", "round"], study)
    assert tables_equal(chained, done.variants[("round", "globalrec")], ["p_partkey"]).first()["equal"]
    for v in done.variants.values():
        assert v.columns == ["p_partkey", *fields] and v.count() == part.count()


def test_failed_scoring_is_a_status(spark, part, monkeypatch):
    from veilspark.plans import deidentify

    def broken(*_):
        raise ValueError("no linkage today")

    monkeypatch.setattr(deidentify, "rl_value", broken)
    df = part.select("p_partkey", "p_brand", "p_size")
    done = deidentify.evaluate(df, study_of(df, None, ["p_partkey"], seed="s"), ["globalrec"])
    row = done.risk.first()
    assert "no linkage today" in row["status"]
    assert [r["status"] for r in deidentify.risk_report(done.risk).where("comb = 'O'").collect()] == ["original"]
    assert row["rl"] is None and row["status"].startswith("failed") and row["fk"] is not None


def test_tables_as_bags_and_by_id(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (1, "x")], "k int, v string")
    c = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    assert tables_equal(a, b).first()["equal"] and not tables_equal(a, c).first()["equal"]
    ids = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    gone = spark.createDataFrame([(1, "y")], "k int, v string")
    assert changed_values(gone, ids, ["k"]).first()["changed"] == 2


def test_merging_batches_keeps_a_row_once(spark):
    a = spark.createDataFrame([(1, 1, 0.5)], "ds_id int, variant_id int, rl double")
    b = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "ds_id int, variant_id int, rl double")
    b = b.withColumn("rl", F.col("rl") * 2)
    for batches, rl in (([a, b], 1.0), ([b, a], 0.5)):
        merged = tables.merge_batches(batches, ["ds_id", "variant_id"])
        assert {r["ds_id"]: r["rl"] for r in merged.collect()} == {1: rl, 2: 1.4}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream_equals_batch(spark, tmp_path):
    from conftest import SMALL

    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "value")
    policies = [fit_fences(events), fit_rounding(events, ["value"], 5.0)]
    stream = spark.readStream.schema(events.schema).parquet(f"{SMALL}/events*.parquet")
    run_available(protect_stream(stream, policies), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = protect_stream(events, policies)
    assert tables_equal(spark.read.parquet(str(tmp_path / "out")), batch).first()["equal"]


def test_prepare_features(spark):
    rows = [(i, f"name{i:03d}", "ab"[i % 2], float(i % 4), i, "yn"[i % 3 == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, name string, kind string, x double, key int, y string")
    done = features.prepare(df, "y", ["id"])
    assert set(done.feature_names) == {"x", "kind_vec"}
    assert len(done.table.first()["features"]) == 3
    assert {r["label"] for r in done.table.select("label").distinct().collect()} == {0.0, 1.0}


def test_null_has_no_level(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "id int, c string")
    found = {r["id"]: list(r["v"].toArray()) for r in features.one_hot_vector(df, "c", "v").collect()}
    assert found == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 1.0], 4: [1.0, 0.0]}


def test_collection_is_written_one_by_one(spark, part, tmp_path):
    from veilspark.plans.deidentify import evaluate_collection

    fields = ["p_brand", "p_size"]
    df = part.select("p_partkey", *fields)
    study = study_of(df, None, ["p_partkey"], min_score=2, seed="s", approximate=True)

    def write(ds_id, done):
        for number, variant in enumerate(done.variants.values()):
            tables.write_variant(variant, str(tmp_path), ds_id, number)

    risk = evaluate_collection({0: (df, study), 1: (df.limit(50), study)}, write, techniques=["globalrec"])
    assert sorted(r["ds_id"] for r in risk.collect()) == [0, 1]
    assert tables.read_variant(spark, str(tmp_path), 1, 0).count() == 50


def test_settled_noise_is_the_same_noise(part):
    from veilspark.operators.noise import fit_noise

    policy = fit_noise(part, ["p_partkey"], "s", ["p_retailprice"], ["p_brand"])
    same = tables_equal(policy.transform(part), policy.settled().transform(part), ["p_partkey"])
    assert same.first()["equal"]
