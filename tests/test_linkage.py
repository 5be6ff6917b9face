"""Linkage against worked examples and against brute force in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F
from veilspark.operators import linkage
from veilspark.operators.linkage import linkage_risk, linked_pairs, rl_value
from veilspark.operators.near_text import near_text_pairs

FIELDS = ["city", "job", "age", "pts"]
SCHEMA = "city string, job string, age int, pts int, id int"


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Tables of a few rows: compiling the plans takes longer than running them."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


@pytest.fixture(scope="module")
def worked(spark):
    original = spark.createDataFrame(
        [("A", "x", 30, 5, 0), ("A", "x", 40, 9, 1), ("B", "y", 50, 7, 2)], SCHEMA
    )
    protected = spark.createDataFrame(
        [("A", "x", 30, 5, 0), ("A", "*", 45, 9, 1), ("B", "y", 51, 7, 2)], SCHEMA
    )
    return protected, original


@pytest.fixture(params=[(256, 6), (0, 6), (0, 0)], ids=["direct", "keys", "split"])
def way(request, monkeypatch):
    """All ways of finding pairs: small blocks pair by pair, large blocks by keys, which are split."""
    monkeypatch.setattr(linkage, "DIRECT_BLOCK", request.param[0])
    monkeypatch.setattr(linkage, "LOADED", request.param[1])


@pytest.mark.parametrize("score, expected", [(2, 66.666667), (3, 66.666667), (4, 33.333333)])
def test_worked_example(worked, way, score, expected):
    found = linkage_risk(*worked, FIELDS, "city", score).first()[0]
    assert found == pytest.approx(expected, abs=1e-6)


def test_worked_example_indexed(worked, way):
    found = linkage_risk(*worked, FIELDS, "city", score="indexed", id_cols=["id"]).first()[0]
    assert found == 100.0


def test_pairs_of_worked_example(worked, way):
    rows = linked_pairs(*worked, FIELDS, ["id"], "city", 1).collect()
    found = {(r["id_protected"], r["id_original"]): r["similarity"] for r in rows}
    assert found == {(0, 0): 4.0, (0, 1): 2.0, (1, 1): 2.0, (2, 2): 3.5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b, numeric):
    if a is None or b is None:
        return 0.0
    if numeric:
        return max(0.0, 1 - abs(a - b) / 2)
    longest = max(len(a), len(b))
    return float(longest > 0 and 1 - edits(a, b) / longest >= 0.9)


def brute(protected, original, numeric, block, min_score):
    """Pairs by comparing everything with everything."""
    out = []
    for i, p in enumerate(protected):
        for j, o in enumerate(original):
            if block is not None and (p[block] is None or p[block] != o[block]):
                continue
            total = round(sum(similarity(a, b, n) for a, b, n in zip(p, o, numeric)), 9)
            if total > 1 and total >= min_score:
                out.append((i, j))
    return out


def share(pairs, n):
    counts = {}
    for i, _ in pairs:
        counts[i] = counts.get(i, 0) + 1
    return 100.0 * sum(c == 1 for c in counts.values()) / n


WORDS = ["", "*", "blue", "green", "administrative", "administrativo", "administratixx", "longer text of thirty letters!!", "longer text of thirty lettrs!!x"]


def random_rows(rng, n):
    return [
        (
            rng.choice(["A", "A", "A", "B", "", None]),
            rng.choice(WORDS + [None]),
            rng.choice([None, *range(8)]),
            rng.choice([0.0, 0.1 + 0.2, 0.3, 1.25, 2.0, 2.3, 7.5, -0.5, None]),
            rng.choice([1, 2, 3]),
        )
        for _ in range(n)
    ]


NUMERIC = (False, False, True, True, True)
RANDOM_SCHEMA = "b string, t string, i int, d double, k int"


@pytest.mark.parametrize(
    "block, min_score", [("b", 1), ("b", 2.5), ("k", 3), (None, 2.5)]
)
def test_against_brute_force(spark, way, block, min_score):
    if block is None and linkage.DIRECT_BLOCK:
        pytest.skip("without a block there is one way only")
    rng = random.Random(7 * min_score + len(block or ""))
    left, right = random_rows(rng, 60), random_rows(rng, 50)
    names = ["b", "t", "i", "d", "k"]
    expected = brute(left, right, NUMERIC, names.index(block) if block else None, min_score)
    frames = [
        spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], RANDOM_SCHEMA + ", id int")
        for rows in (left, right)
    ]
    indexer = "block" if block else "full"
    pairs = linked_pairs(*frames, names, ["id"], block, min_score, indexer=indexer)
    found = [(r["id_protected"], r["id_original"]) for r in pairs.collect()]
    assert sorted(found) == sorted(expected)
    risk = linkage_risk(*frames, names, block, min_score, indexer=indexer).first()[0]
    assert risk == pytest.approx(share(expected, 60))


@pytest.mark.parametrize("loaded", [6, 0])
def test_many_fields_use_groups_of_fields(spark, monkeypatch, loaded):
    monkeypatch.setattr(linkage, "DIRECT_BLOCK", 0)
    monkeypatch.setattr(linkage, "LOADED", loaded)
    rng = random.Random(3)
    make = lambda: [tuple(rng.choice([0.0, 0.5, 1.0, 3.0]) for _ in range(11)) for _ in range(40)]
    left, right = make(), make()
    names = [f"c{i}" for i in range(11)]
    schema = ", ".join(f"{c} double" for c in names) + ", id int"
    frames = [spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], schema) for rows in (left, right)]
    for score in (7, 8.5):
        rule = linkage.linkage_rule(*frames, names, "c0", score)
        assert len(rule.key_sets()[1]) < 10
        expected = brute(left, right, (True,) * 11, 0, score)
        found = linked_pairs(*frames, names, ["id"], "c0", score).collect()
        assert sorted((r["id_protected"], r["id_original"]) for r in found) == sorted(expected)
        assert linkage_risk(*frames, names, "c0", score).first()[0] == pytest.approx(share(expected, 40))


def met_per_row(spark, rows, names, schema, block, min_score):
    """Pairs that meet for each protected row, and how many levels of splitting that took."""
    df = spark.createDataFrame(rows, schema)
    rule = linkage.linkage_rule(df, df, names, block, min_score)
    side = linkage._side(df, rule, ())
    _, cover = rule.key_sets()
    a, o, levels = linkage._keyed_sides(side, side, rule, cover, ["p", "w"], ["p", "w"], {})
    return a.select("key").join(o.select("key"), "key").count() / len(rows), levels


@pytest.mark.parametrize("kind", ["continuous", "texts"])
def test_meeting_pairs_do_not_grow_with_the_square(spark, monkeypatch, kind):
    """Twice the rows, well under twice the pairs for each: loaded keys are split by more fields."""
    rng = random.Random(13)
    names = [f"c{i}" for i in range(5 if kind == "continuous" else 12)]
    value = (lambda: rng.uniform(0, 50)) if kind == "continuous" else (lambda: f"v{rng.randrange(6)}")
    schema = ", ".join(f"{c} {'double' if kind == 'continuous' else 'string'}" for c in names)
    rows = [(1.0 if kind == "continuous" else "b", *[value() for _ in names[1:]]) for _ in range(4000)]
    monkeypatch.setattr(linkage, "LOADED", 2)  # so that few rows show it
    few, _ = met_per_row(spark, rows[:2000], names, schema, "c0", None)
    many, levels = met_per_row(spark, rows, names, schema, "c0", None)
    assert levels and many < 1.6 * few
    monkeypatch.setattr(linkage, "LOADED", 1 << 30)
    unsplit, _ = met_per_row(spark, rows, names, schema, "c0", None)
    assert many < unsplit / 3


def test_near_texts_are_all_found(spark):
    rng = random.Random(5)
    values = set()
    for size in (9, 10, 12, 19, 20, 21, 29, 30, 33, 45):
        for _ in range(6):
            base = "".join(rng.choice("ab") for _ in range(size))
            values.add(base)
            for _ in range(4):
                changed = list(base)
                for _ in range(rng.randint(1, max(size // 10, 1) + 1)):
                    kind, at = rng.choice("dis"), rng.randrange(len(changed))
                    if kind == "d":
                        del changed[at]
                    elif kind == "i":
                        changed.insert(at, rng.choice("ab"))
                    else:
                        changed[at] = rng.choice("ab")
                values.add("".join(changed))
    df = spark.createDataFrame([(v,) for v in sorted(values)], "t string")
    found = {(r["lv"], r["rv"]) for r in near_text_pairs(df, df, "t", 60).collect()}
    expected = {(a, b) for a in values for b in values if a != b and similarity(a, b, False) == 1}
    assert found == expected and expected


def test_hot_group_is_settled_without_pairs(spark, monkeypatch):
    """Most rows share one block and one text: no pair of theirs is formed."""
    monkeypatch.setattr(linkage, "DIRECT_BLOCK", 0)
    rows = spark.range(4000).select(
        F.lit("hot").alias("b"), F.lit("same").alias("t"), (F.col("id") * 10.0).alias("d"), F.col("id").cast("int").alias("id")
    )
    few = spark.createDataFrame([("hot", "rare", 7.0, 9001), ("cold", "x", 1.0, 9002)], "b string, t string, d double, id int")
    df = rows.unionByName(few)
    names = ["b", "t", "d"]
    rule = linkage.linkage_rule(df, df, names, "b", 2)
    side = linkage._side(df, rule, ())
    enough, cover = rule.key_sets()
    rest = linkage.unresolved_rows(side, side, rule, enough)
    assert rest.count() == 2
    met = linkage._cover_rows(rest, rule, cover, ["p", "w"], True, {}).join(
        linkage._cover_rows(side, rule, cover, ["w"], False, {}).select("key"), "key"
    )
    assert met.count() < 10
    assert linkage_risk(df, df, names, "b", 2).first()[0] == pytest.approx(100.0 * 2 / 4002)


def test_duplicates_count_as_two_links(spark, way):
    df = spark.createDataFrame([("A", 1, 5.0)] * 2 + [("A", 9, 7.0)], "b string, i int, d double")
    one = df.limit(3)
    assert linkage_risk(one, df, ["b", "i", "d"], "b", 3).first()[0] == pytest.approx(100 / 3)


def test_mixed_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "DIRECT_BLOCK", 20)
    rng = random.Random(11)
    left, right = random_rows(rng, 80), random_rows(rng, 80)
    frames = [
        spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], RANDOM_SCHEMA + ", id int") for rows in (left, right)
    ]
    expected = brute(left, right, NUMERIC, 0, 3)
    risk = linkage_risk(*frames, ["b", "t", "i", "d", "k"], "b", 3).first()[0]
    assert risk == pytest.approx(share(expected, 80))


def test_arguments_are_checked(worked):
    protected, original = worked
    for bad in (
        {"block": ""}, {"block": "nowhere"}, {"indexer": ""}, {"score": "other"},
    ):
        with pytest.raises(ValueError):
            linkage_risk(protected, original, FIELDS, **{"block": "city", **bad})
    with pytest.raises(ValueError):
        linkage.linkage_rule(protected, original.drop("pts"), FIELDS, "city")


def test_default_scores(worked):
    rule = linkage.linkage_rule(*worked, FIELDS, "city")
    assert rule.min_score == math.floor(0.7 * 4)
    assert linkage.linkage_rule(*worked, FIELDS, "city", score="indexed").min_score == int(7 * 0.7)


def test_one_valued_block_has_no_risk(spark):
    df = spark.createDataFrame([("*", "*"), ("*", "*")], "a string, b string")
    assert rl_value(df, df, ["a", "b"]) == (0.0, "a")


def test_empty_table(spark, way):
    df = spark.createDataFrame([], "a string, b int")
    assert linkage_risk(df, df, ["a", "b"], "a").first()[0] is None


def reference_rl(rows, others, min_score):
    """Brute force over a text block, a whole number and a double."""
    single = 0
    for b, n, x in rows:
        links = 0
        for c, m, y in others:
            if b is None or b != c:
                continue
            score = 1.0
            if n is not None and m is not None:
                score += max(0.0, 1 - abs(n - m) / 2)
            if x is not None and y is not None and math.isfinite(x) and math.isfinite(y):
                score += max(0.0, 1 - abs(x - y) / 2)
            links += round(score, 9) > 1 and round(score, 9) >= min_score
        single += links == 1
    return 100 * single / len(rows)


@pytest.mark.parametrize("min_score", [1.5, 1.9, 2.0, 2.5, 3.0])
def test_extreme_numbers_link_the_same_both_ways(spark, way, min_score):
    rng = random.Random(int(10 * min_score))
    whole = [0, 1, -1, 5, 2**40, 2**53, 2**53 + 1, 2**60 + 7, -(2**62), 2**63 - 1, -(2**63), None]
    real = [0.0, -0.0, 1.5, 2.0, 1e9, 2.0**51, 2.0**51 + 1, 2.0**52, 2.0**53, 1e25, 3e25, 1e300, -1e25, math.inf, -math.inf, math.nan, None]

    def near(v):
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return v
        moved = v + rng.choice([0, 0, 1, -1, 2])
        return max(-(2**63), min(2**63 - 1, moved)) if isinstance(v, int) else float(moved)

    originals = [("b", rng.choice(whole), rng.choice(real)) for _ in range(60)]
    protected = [(b, near(n), near(x)) for b, n, x in originals]
    schema = "b string, n bigint, x double"
    a, o = spark.createDataFrame(protected, schema), spark.createDataFrame(originals, schema)
    found = linkage_risk(a, o, ["b", "n", "x"], "b", min_score).first()[0]
    plain = [[(b, n, None if x is not None and math.isnan(x) else x) for b, n, x in rows] for rows in (protected, originals)]
    assert found == pytest.approx(reference_rl(*plain, min_score), abs=1e-9)


@pytest.mark.parametrize("block, min_score", [("b", 2.5), ("k", 3), (None, 2.5)])
def test_pairs_of_repeated_rows(spark, way, block, min_score):
    """Rows that are equal in all fields, nulls included, are compared once and all named."""
    rng = random.Random(5)
    few = random_rows(rng, 12)
    protected, original = ([rng.choice(few) for _ in range(60)] for _ in range(2))
    schema = f"{RANDOM_SCHEMA}, id int"
    sides = [spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema) for rows in (protected, original)]
    where = None if block is None else "btidk".index(block)
    found = linked_pairs(*sides, list("btidk"), ["id"], block, min_score, indexer="full" if block is None else "block")
    assert sorted((r[0], r[1]) for r in found.collect()) == sorted(brute(protected, original, NUMERIC, where, min_score))


def test_equal_rows_are_compared_once(spark, monkeypatch):
    seen = []
    pairs = linkage._all_pairs
    monkeypatch.setattr(linkage, "_all_pairs", lambda left, right, *a: (seen.extend((left.count(), right.count())), pairs(left, right, *a))[1])
    rows = spark.createDataFrame([("A", "x", 30, 5, i) for i in range(40)], SCHEMA)
    assert linked_pairs(rows, rows, FIELDS, ["id"], "city", 3).count() == 1600
    assert seen == [1, 1]


def test_keys_are_never_broadcast(spark, part, way):
    """A side that unfolds into keys is far larger than the files that Spark judges it by."""
    protected = part.withColumn("p_retailprice", F.round("p_retailprice"))
    fields = ["p_brand", "p_type", "p_size", "p_retailprice"]
    for found in (linked_pairs(protected, part, fields, ["p_partkey"], "p_size", 3), linkage_risk(protected, part, fields, "p_size", 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert "SortMergeJoin" in plan
        assert not [j for j in joins if "key" in j or "class" in j or "l_f" in j]


def test_joins_test_a_short_bound(spark, part, way):
    """What decides on most pairs stands in the join, and the long rest does not: it was too long to be compiled."""
    protected = part.withColumn("p_retailprice", F.round("p_retailprice"))
    found = linkage_risk(protected, part, ["p_brand", "p_type", "p_size", "p_retailprice"], "p_size", 3)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "r_f1" in line]
    assert joins and all("octet_length" in j and "levenshtein" not in j and "round" not in j for j in joins)


def test_bound_keeps_what_links(spark, way):
    """Scores at the threshold, distances beyond 64 bits and infinite numbers."""
    top = 2**63 - 1
    rows = [("A", "thirteen long", top, 0.1 + 0.2), ("A", "thirteen l0ng", -top, 0.3), ("A", "", top - 1, float("inf")), ("A", None, None, None)]
    sides = [spark.createDataFrame(x, "b string, t string, i bigint, d double") for x in (rows, rows[::-1])]
    def similar(l, r):
        text = l[1] is not None and r[1] is not None and l[1] != "" and (l[1] == r[1] or {l[1], r[1]} == {rows[0][1], rows[1][1]})
        near = lambda x, y: 0.0 if x is None or y is None or math.inf in (x, y) else max(0.0, 1 - abs(x - y) / 2)
        return round(1 + text + near(l[2], r[2]) + near(l[3], r[3]), 9)
    for least in (1.5, 2, 3, 4):
        links = [sum(similar(l, r) > 1 and similar(l, r) >= least for r in rows) for l in rows]
        assert linkage_risk(*sides, list("btid"), "b", least).first()[0] == pytest.approx(100 * links.count(1) / len(rows))


def test_near_texts_meet_within_their_block(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([9, 10, 12, 21, 31]))) for _ in range(60)]
    words += [w[:3] + "x" + w[4:] for w in words]
    sides = [sorted({(rng.choice("PQR"), w) for w in rng.sample(words, 80)}) for _ in range(2)]
    frames = [spark.createDataFrame(rows, "f0 string, f1 string") for rows in sides]
    found = near_text_pairs(*frames, "f1", 31, "f0")
    expected = sorted((b, v, w) for b, v in sides[0] for c, w in sides[1] if b == c and v != w and similarity(v, w, False))
    assert expected and sorted(map(tuple, found.collect())) == expected
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
