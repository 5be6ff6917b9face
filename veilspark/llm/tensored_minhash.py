"""Near duplicates on word shingles: tensored MinHash banding, then exact verification.

Two collections of ``tables`` short keys are computed from ``2 * tables * rows`` minhashes of
each text. Every pair of a key of the first collection and a key of the second is the key of
one of ``tables ** 2`` tables, which would take ``2 * tables ** 2 * rows`` minhashes otherwise.
A pair of texts with Jaccard similarity s shares a table with probability
``(1 - (1 - s ** rows) ** tables) ** 2``: above 0.99996 for the defaults at s = 0.75, and more
beyond. Candidates are confirmed on the full shingle sets; components of confirmed links are
the groups.

Texts with equal shingle sets are one class from the start, so copies never meet. Inside a
table key no pairs are listed at first: in every round a few texts of a key (pivots, four times
as many each round) are compared with the others of the key that are not yet known to be in
their component, and then leave the key. When few enough pairs are open for each member, and the
last round's pivots say that no more of them than members will be listed, they are compared
outright; while large groups of similar texts still face each other, pivots go on. A pair is only listed if the parities of both sets allow the similarity:
shingles of both cancel out in the exclusive or of two parity maps, so every bit left over is a
shingle of one set alone; and it is listed only under the first table that both share.
A key of many members is dealt to several tasks, each of which sees all pivots.
Every pair of texts that share a table is thus either compared or already connected.

Defined results: a null or empty text and one without words has no shingles, links with
nothing and is its own group. Texts of fewer words than a shingle are compared as a whole.
Rows with equal texts are in one group even if an id repeats; ``component_id`` is the smallest
id of the group that is not null, and null if there is none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.components import smallest_reachable
from veilspark.llm.storage import BROADCAST_BYTES, discard, in_tasks, kept, small_side, text_key


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  # words
    similarity: tuple[int, int] = (75, 100)  # numerator and denominator of the Jaccard threshold
    tables: int = 20  # keys of each collection
    rows: int = 3  # minhashes of each key
    first_rounds: int = 3  # of pivots in the diagonal tables
    open_pairs: int = 256  # pairs for each member of a key that may be compared outright
    members: int = 65_536  # of a key that meet its pivots in one task
    seed: int = 5


MAP_WORDS = 16
MAPS = [f"m{i}" for i in range(MAP_WORDS)]
_SIGNED = "t1 long, t2 long, k1 long, k2 long, n_shingles long, first array<long>, second array<long>"


def _signatures(s: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(s.seed)
    n = 2 * s.tables * s.rows
    factor = rng.integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1)
    spread = rng.integers(1, 2**64, s.rows, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        parts = []
        for _, _, data, offsets in W.slices(batch.column("text")):
            h, first = W.shingles_of(W.words_of(data, offsets), s.shingle)
            distinct, at = W.distinct_within(h, first)
            k1, k2 = W.set_keys(distinct, at)
            has = np.diff(at) > 0
            keys = np.zeros((2 * s.tables, len(has)), dtype=np.uint64)
            for i in range(2 * s.tables if has.any() else 0):
                for r in range(s.rows):
                    lowest = np.minimum.reduceat(distinct * factor[i * s.rows + r], at[:-1][has])
                    keys[i, has] += W.mix(lowest) * spread[r]
            keys = W.as_long(np.ascontiguousarray(W.mix(keys).T))
            parts.append((W.as_long(k1), W.as_long(k2), np.diff(at), keys))
        if not parts:
            continue
        keys = np.concatenate([p[3] for p in parts])
        half = s.tables

        def lists(values: np.ndarray) -> pa.Array:
            return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), half).cast(pa.list_(pa.int64()))

        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in batch.schema.names if c != "text"),
                *(pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(3)),
                lists(np.ascontiguousarray(keys[:, :half])),
                lists(np.ascontiguousarray(keys[:, half:])),
            ],
            names=[c for c in batch.schema.names if c != "text"] + ["k1", "k2", "n_shingles", "first", "second"],
        )


def _sets(s: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in W.slices(batch.column("text")):
            distinct, at = W.distinct_within(*W.shingles_of(W.words_of(data, offsets), s.shingle))
            k1, k2 = W.set_keys(distinct, at)
            lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(W.as_long(distinct))).cast(pa.list_(pa.int64()))
            bits = np.uint64(1) << (distinct & np.uint64(63))
            word = (distinct >> np.uint64(6)) & np.uint64(MAP_WORDS - 1)
            maps = []
            for i in range(MAP_WORDS):
                own = np.append(np.where(word == i, bits, np.uint64(0)), np.uint64(0))
                maps.append(W.as_long(np.bitwise_xor.reduceat(own, at[:-1]) * (np.diff(at) > 0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.as_long(k1)), pa.array(W.as_long(k2)), lists, *map(pa.array, maps)],
                names=["k1", "k2", "shingles", *MAPS],
            )


def _shared_halves(halves: DataFrame, by: str) -> DataFrame:
    """The keys of ``halves(node, n, second, at, key, ...)`` that hold several values of ``by``, as lists per class.

    A key of one collection that no other class has cannot be half of a shared table key, so
    such keys are dropped before pairs of keys are formed. ``(node, n, a, b)``.
    """
    several = halves.groupBy("key").agg(F.min(by).alias("low"), F.max(by).alias("high")).filter("low < high").select("key")
    return (
        halves.join(several, "key")
        .groupBy("node", "n")
        .agg(
            F.collect_list(F.when(~F.col("second"), F.struct("at", "key"))).alias("a"),
            F.collect_list(F.when(F.col("second"), F.struct("at", "key"))).alias("b"),
        )
        .filter("size(a) > 0 and size(b) > 0")
    )


def _halves(classes: DataFrame) -> DataFrame:
    """``(node, n, second, at, key)``: the keys of both collections of every class."""
    each = classes.select(
        "node",
        "n",
        F.explode(
            F.concat(
                F.transform("first", lambda x, i: F.struct(F.lit(False).alias("second"), i.alias("at"), x.alias("key"))),
                F.transform("second", lambda x, i: F.struct(F.lit(True).alias("second"), i.alias("at"), x.alias("key"))),
            )
        ).alias("half"),
    )
    return each.select("node", "n", "half.second", "half.at", F.xxhash64("half.second", "half.at", "half.key").alias("key"))


def _table_members(both: DataFrame, diagonal: bool) -> DataFrame:
    """``(bucket, i, j, node, n)`` of key lists ``both(node, n, a, b)``; ``i, j`` number the two keys that a table pairs.

    With ``diagonal`` only tables of equal numbers are built.
    """
    tables = both.select("node", "n", "b", F.explode("a").alias("x")).select("node", "n", "x", F.explode("b").alias("y"))
    tables = tables.filter("x.at = y.at") if diagonal else tables
    return tables.select(F.xxhash64("x.key", "y.key").alias("bucket"), F.col("x.at").alias("i"), F.col("y.at").alias("j"), "node", "n")


def _possible(s: Settings):
    """Whether parity maps of two members allow the similarity; a necessary condition."""
    p, q = s.similarity
    apart = [F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in MAPS]
    return sum(apart[1:], apart[0]) * (p + q) <= (F.col("na") + F.col("nb")) * (q - p)


def _sizes_allow(s: Settings):
    p, q = s.similarity
    return (F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p)


def _first_common(diagonal: bool):
    """Whether a table is the first of all, or of the diagonal ones, that two members share.

    A pair is so listed under one of its tables only. Keys of different numbers never agree.
    """

    def none_before(keys: str, at: str):
        return ~F.arrays_overlap(F.slice(f"a{keys}", F.lit(1), F.col(at)), F.slice(f"b{keys}", F.lit(1), F.col(at)))

    return none_before("both", "i") if diagonal else none_before("first", "i") & none_before("second", "j")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    p, q = s.similarity
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(both * q >= (F.size("left") + F.size("right") - both) * p)
        .select("a", "b")
    )


def _rounds(
    members: DataFrame,
    sets: DataFrame,
    s: Settings,
    links: DataFrame,
    label: DataFrame | None,
    diagonal: bool,
    listed: float = float("inf"),
) -> tuple[DataFrame, DataFrame | None, float]:
    """Links found so far with those of more rounds, the components they make, and ``listed``.

    In the diagonal tables there are ``s.first_rounds`` of pivots, in all tables they go on to the end.
    ``listed`` is the share of the pairs met in the last round that were listed.
    What is shuffled by key is a row of ids; sets are fetched for listed pairs only.
    """
    pivots, done = 1, 0
    keys = [F.zip_with("first", "second", lambda x, y: F.xxhash64(x, y)).alias("both")] if diagonal else ["first", "second"]
    marks = sets.select("node", *MAPS, *keys)
    few_marks = sets.count() * (8 * (MAP_WORDS + 2 * s.tables) + 64) <= BROADCAST_BYTES
    before = None
    while not diagonal or done < s.first_rounds:
        if label is None:
            now = members.withColumn("group", F.col("node"))
        else:
            now = members.join(small_side(label, 16), "node", "left").withColumn("group", F.coalesce("group", "node"))
        load = kept(
            now.groupBy("bucket", "group")
            .agg(F.count("*").alias("c"), F.min("node").alias("candidate"))
            .groupBy("bucket")
            .agg(
                F.sum("c").alias("m"),
                F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"),
                F.min(F.struct("c", "candidate")).getField("candidate").alias("pivot"),
                F.count("*").alias("groups"),
            )
            .filter("groups > 1"),
            "near-load",
        )
        pairs_open = (F.col("m").cast("double") * F.col("m") - F.col("squares")) / 2
        # A pair is met if one of both is a pivot.
        met = pairs_open * F.least(F.lit(1.0), F.lit(2.0 * pivots) / F.col("m"))
        total = load.agg(F.sum("m"), F.sum(pairs_open), F.sum(met)).first()
        if total[0] is None:
            discard(load, before)
            break
        last = not diagonal and total[1] <= s.open_pairs * total[0] and listed * total[1] <= total[0]
        share = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(1 << 30)).cast("double") / (1 << 30)
        is_pivot = (F.col("node") == F.col("pivot")) | (share * F.col("m") < pivots - 1)
        open_now = kept(now.join(small_side(load.select("bucket", "pivot", "m"), 24), "bucket").withColumn("is_pivot", is_pivot).drop("pivot"), "near-open")
        discard(load, before)
        shares = F.ceil(F.col("m") / s.members).cast("int")

        def side(x: str, rows: DataFrame, names: list[str]) -> DataFrame:
            # Narrow rows are shuffled if the marks fit beside them afterwards.
            rows = rows.repartition("bucket", "share") if few_marks else rows
            rows = rows.join(F.broadcast(marks) if few_marks else marks, "node")
            own = [F.col(c).alias(f"{x}{c}") for c in marks.columns if c != "node"]
            return rows.select("bucket", "share", *names, *own, F.col("node").alias(x), F.col("group").alias(f"g{x}"), F.col("n").alias(f"n{x}"))

        one = open_now if last else open_now.filter("is_pivot")
        one = side("a", one.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))), ["i", "j"])
        other = side("b", open_now.withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int")), [])
        pairs = one.join(other, ["bucket", "share"]).filter(
            (F.col("ga") != F.col("gb")) & _sizes_allow(s) & _possible(s) & _first_common(diagonal)
        )
        pairs = pairs.filter("a < b") if last else pairs
        pairs = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        listed = pairs.count() / total[2]
        known, links = links, kept(links.unionByName(_confirmed(pairs, sets, s)), "near-links")
        discard(pairs, known)
        if last:
            discard(open_now)
            break
        done_with, label = label, kept(smallest_reachable(links, 3).select("node", F.col("root").alias("group")), "near-label")
        discard(done_with)
        members, before = open_now.filter("not is_pivot").select("bucket", "i", "j", "node", "n"), open_now
        pivots, done = pivots * 4, done + 1
    return links, label, listed


def _links(classes: DataFrame, both: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links that connect all classes which similar pairs of the tables connect.

    A similar pair shares dozens of tables, so a few rounds over the diagonal ones connect
    most of what belongs together; then only keys that still hold several groups are paired.
    """
    none = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    links, label, listed = _rounds(_table_members(both, True), sets, s, none, None, True)
    if label is not None:
        kinds = [F.transform(c, lambda x: F.struct(F.lit(c == "b").alias("second"), x["at"].alias("at"), x["key"].alias("key"))) for c in "ab"]
        halves = both.select("node", "n", F.explode(F.concat(*kinds)).alias("half")).select("node", "n", "half.second", "half.at", "half.key")
        halves = halves.join(small_side(label, 16), "node", "left").withColumn("group", F.coalesce("group", "node"))
        both = kept(_shared_halves(halves, "group"), "near-open-keys")
    return _rounds(_table_members(both, False), sets, s, links, label, False, listed)[0]


def near_duplicates(
    docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", with_keys: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    ``with_keys`` adds ``group_id`` (null without shingles) and the text's keys ``t1, t2``.
    """
    t1, t2 = text_key(F.col(text_col))
    named = docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    signed = kept(in_tasks(named, lambda it: _signatures(s, it), f"id {kind}, {_SIGNED}"), "near-signed")
    classes = kept(
        signed.filter("n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(
            F.min("id").alias("smallest"),
            F.min(F.struct("t1", "t2")).alias("t"),
            F.first("n_shingles").alias("n"),
            F.first("first").alias("first"),
            F.first("second").alias("second"),
        )
        .select("k1", "k2", "smallest", "t.t1", "t.t2", "n", "first", "second", F.monotonically_increasing_id().alias("node")),
        "near-classes",
    )
    both = kept(_shared_halves(_halves(classes), "node"), "near-shared-keys")
    wanted = kept(classes.join(both.select("node"), "node", "left_semi").select("t1", "t2", "k1", "k2", "node", "n", "first", "second"), "near-wanted")
    texts = named.select("t1", "t2", "text").join(small_side(wanted.select("t1", "t2"), 16), ["t1", "t2"], "left_semi")
    sets = kept(
        in_tasks(texts.select("text"), lambda it: _sets(s, it), "k1 long, k2 long, shingles array<long>, " + ", ".join(f"{m} long" for m in MAPS))
        .dropDuplicates(["k1", "k2"])
        .join(wanted.select("k1", "k2", "node", "n", "first", "second"), ["k1", "k2"])
        .select("node", "n", "shingles", *MAPS, "first", "second"),
        "near-sets",
    )
    roots = smallest_reachable(_links(classes, both, sets, s))
    component = classes.select("node", "smallest").join(roots, "node").groupBy("root").agg(F.min("smallest").alias("component"))
    known = kept(roots.join(component, "root").select("node", "root", "component"), "near-components")
    own = (
        classes.select("k1", "k2", "node", "smallest")
        .join(known, "node", "left")
        .select("k1", "k2", F.coalesce("root", "node").alias("group_id"), F.coalesce("component", "smallest").alias("of_class"))
    )
    result = signed.select("id", "t1", "t2", "n_shingles", "k1", "k2").join(own, ["k1", "k2"], "left")
    has = F.col("n_shingles") > 0
    component_id = F.when(has, F.col("of_class")).otherwise(F.col("id"))
    return result.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component_id.alias("component_id"),
        F.coalesce(F.col("id") == component_id, component_id.isNull()).alias("kept"),
        *([F.when(has, F.col("group_id")).alias("group_id"), "t1", "t2"] if with_keys else []),
    )
