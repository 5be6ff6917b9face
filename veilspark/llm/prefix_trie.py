"""The trie of conversation beginnings, built by peeling turns off from the deepest end.

A conversation is a path of turns, each named by two 64-bit hashes of its role and text together
with its depth, and by the words of its text. Equal conversations are merged first. Then, from
the greatest depth to the root, the conversations that end at a depth are merged with the nodes
that survive from below: all are grouped by their path, which gives the nodes of this depth;
these lose their last turn and go on to the next depth. Sums over a subtree travel with the
survivors, so nodes are found and aggregated in the same pass. Grouping combines before
its shuffle, and a node travels once to its parent however many conversations hang on it.

Depths that few conversations reach would each cost a job. The depth ``m`` is measured below which
every group of longer conversations with an equal beginning of ``m`` turns has at most
``group_turns`` turns left; these groups are peeled inside tasks, by the same steps, down to
``m``. Larger groups are never gathered: ``m`` is then greater, and the result is the same.

The ids that end in a node are hashed as one text in numeric order. This digest is sequential by its
definition: ids are joined in runs of at most 65,536 numbers, and one task reads a node's runs as
a stream, in bounded memory.

Defined results: turns are ordered by ``turn`` (null first), then by role and text; a null role or
text is empty. Rows without a conversation id take no part. Without conversations there is no
node. Only the four named columns are read, so extra columns do not matter. A conversation
is one row of 24 bytes per turn, its longest text stays behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import in_tasks, kept

WORD = r"[^\x20\x09-\x0D]+"
RUN = 1 << 16
TURN = "struct<a:bigint,b:bigint,words:bigint>"


@dataclass(frozen=True)
class Settings:
    group_turns: int = 20_000  # of a group that is peeled inside a task
    depths: int = 8  # at least so many depths from the root are peeled by grouping all rows


def turn_lists(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(base, conv, turns)``: the turns of every conversation in order; ``base`` is ``conv - conv % 20``."""
    conv = F.col(conv_col).cast("long")
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.filter(conv.isNotNull()).select(
        (conv - conv % 20).alias("base"),
        conv.alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.xxhash64(role, text).alias("a"),
            F.xxhash64(F.lit(1), role, text).alias("b"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("t"),
    )
    # Dealt by base, so that joining heads to conversations needs no second shuffle.
    turns = turns.repartition("base").groupBy("base", "conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("base", "conv", F.transform("t", lambda t: F.struct(t["a"], t["b"], t["words"])).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv, turns)``: the first ``h`` turns are those of conversation ``conv - conv % 20``, ``h = crc32(conv) % 4``."""
    heads = turns.filter("conv = base").select("base", F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    both = turns.join(heads, "base", "left").withColumn("h", h)
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.array().cast(f"array<{TURN}>"))
    return both.select("conv", F.concat(head, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def placed(turns: Column) -> Column:
    """A path: turns whose hashes also depend on their depth."""
    return F.transform(
        turns, lambda t, i: F.struct(F.xxhash64(t["a"], i).alias("a"), F.xxhash64(t["b"], i).alias("b"), t["words"].alias("words"))
    )


def path_key(path: Column, part: str) -> Column:
    """One of the two hashes that name a path."""
    return F.aggregate(path, F.lit(0).cast("long"), lambda key, t: key.bitwiseXOR(t[part]))


def shorter(path: str) -> Column:
    return F.expr(f"slice({path}, 1, greatest(size({path}) - 1, 0))")


def deep_limit(ended: DataFrame, deepest: int, s: Settings) -> int:
    """The least depth ``8, 16, 32, ...`` beyond which all groups are small enough for a task."""
    tried = [s.depths << i for i in range(32) if s.depths << i < deepest]
    if not tried:
        return deepest
    each = ended.filter(F.size("path") > tried[0]).withColumn("m", F.explode(F.array(*map(F.lit, tried)))).filter("size(path) > m")
    head = F.expr("slice(path, 1, m)")
    groups = each.groupBy("m", path_key(head, "a").alias("a"), path_key(head, "b").alias("b")).agg(F.sum(F.size("path") - F.col("m")).alias("left"))
    largest = {r.m: r.left for r in groups.groupBy("m").agg(F.max("left").alias("left")).collect()}
    return next((m for m in tried if largest.get(m, 0) <= s.group_turns), deepest)


NODE = "depth int, a long, b long, up_a long, up_b long, conv long, n long, children long, leaves long, saved long"


def peel_group(paths: list[list[tuple[int, int, int]]], convs: list[int], counts: list[int], m: int) -> tuple[list[tuple], tuple]:
    """Nodes deeper than ``m`` of conversations with an equal beginning of ``m`` turns, and what survives at ``m``."""
    keys, words, ending = {}, {}, {}
    for path, conv, n in zip(paths, convs, counts):
        a = b = 0
        chain = []
        for depth, (x, y, w) in enumerate(path, 1):
            up, (a, b) = (a, b), (a ^ x, b ^ y)
            if depth > m:
                keys[a, b], words[a, b] = up, w
                chain.append((a, b))
        ending.setdefault(len(path), []).append((chain[-1], conv, n))
    nodes, live = [], {}
    for depth in range(max(ending), m, -1):
        for key, conv, n in ending.get(depth, []):
            have = live.setdefault(key, [conv, 0, 0, 0, 0])
            have[0] = min(have[0], conv)
            have[1] += n
        above = {}
        for key, (conv, n, children, leaves, saved) in live.items():
            up, leaves, saved = keys[key], leaves if children else 1, saved + (n - 1) * words[key]
            nodes.append((depth, *key, *up, conv, n, children, leaves, saved))
            have = above.setdefault(up, [conv, 0, 0, 0, 0])
            have[0] = min(have[0], conv)
            for i, v in enumerate((n, 1, leaves, saved), 1):
                have[i] += v
        live = above
    ((conv, n, children, leaves, saved),) = live.values()
    return nodes, (conv, n, children, leaves, saved)


def peel_deep(ended: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """Nodes deeper than ``m`` and the survivors at ``m``, peeled inside tasks group by group."""
    long = ended.filter(F.size("path") > m).withColumns({"ha": path_key(F.slice("path", 1, m), "a"), "hb": path_key(F.slice("path", 1, m), "b")})
    names = [f.split()[0] for f in NODE.split(", ")]

    def peel(table: pa.Table) -> pa.Table:
        paths = [[(t["a"], t["b"], t["words"]) for t in p] for p in table["path"].to_pylist()]
        nodes, alive = peel_group(paths, table["conv"].to_pylist(), table["n"].to_pylist(), m)
        head = [None] * len(nodes) + [[{"a": a, "b": b, "words": w} for a, b, w in paths[0][:m]]]
        rows = [*nodes, (m, 0, 0, 0, 0, *alive)]
        out = {c: pa.array([r[i] for r in rows], pa.int32() if c == "depth" else pa.int64()) for i, c in enumerate(names)}
        out["path"] = pa.array(head, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())])))
        return pa.table(out)

    done = kept(long.groupBy("ha", "hb").applyInArrow(peel, f"{NODE}, path array<{TURN}>"), "deep-nodes")
    return done.filter("path is null").select(*names), done.filter("path is not null").select("path", "conv", "n", "children", "leaves", "saved")


def level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth from what ends there and what survives from below. A written table."""
    sums = [F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]]
    nodes = rows.groupBy("path").agg(*sums)
    words = F.coalesce(F.expr("get(path, size(path) - 1)")["words"], F.lit(0))
    up = shorter("path")
    return kept(
        nodes.select(
            F.lit(depth).alias("depth"),
            *[path_key(F.col("path"), k).alias(k) for k in "ab"],
            *[path_key(up, k).alias(f"up_{k}") for k in "ab"],
            "conv",
            "n",
            "children",
            F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * words).alias("saved"),
            "path",
        ),
        "trie-level",
    )


def end_digests(convs: DataFrame) -> DataFrame:
    """``(a, b, depth, ends)``: SHA-256 of the ids whose whole path this is."""
    keyed = convs.select(F.size("path").alias("depth"), *[path_key(F.col("path"), k).alias(k) for k in "ab"], "conv")
    run = F.expr(f"conv div {RUN}").alias("run")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    runs = keyed.groupBy("depth", "a", "b", run).agg(text)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids"))):
                if (d, a, b) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield as_batch(out)
        if node is not None:
            yield as_batch([(*node, state.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"depth": pa.int32(), "a": pa.int64(), "b": pa.int64(), "ends": pa.string()}
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})

    dealt = runs.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "run")
    return in_tasks(dealt.select("depth", "a", "b", "ids"), digests, "depth int, a long, b long, ends string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent``, the id of the node above.

    Parents with more than a thousandth of all nodes as children are a thousand at most; they are
    broadcast, so their children are not dealt out by their key.
    """
    total = nodes.count()
    above = nodes.filter("children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), "children", F.col("conv").alias("parent")
    )
    on = ["depth", "up_a", "up_b"]
    wide = above.filter(F.col("children") * 1000 > total).drop("children")
    met = nodes.join(F.broadcast(wide), on, "left")
    rest = met.filter("parent is null").drop("parent").join(above.filter(F.col("children") * 1000 <= total).drop("children"), on, "left")
    return met.filter("parent is not null").unionByName(rest)


def prefix_trie(turns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per node of the conversations ``turns(conv, turns)``.

    Columns ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    convs = kept(turns.select("conv", placed(F.col("turns")).alias("path")), "paths")
    ended = convs.groupBy("path").agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    ended = kept(ended.sortWithinPartitions(F.size("path")).withColumn("depth", F.size("path")), "distinct-paths")
    deepest = ended.agg(F.max("depth")).first()[0]
    zero = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    columns = ["path", "conv", "n", "children", "leaves", "saved"]
    levels, alive = [], None
    if deepest is not None:
        m = deep_limit(ended, deepest, s)
        if m < deepest:
            deep, alive = peel_deep(ended, m)
            levels.append(deep)
        for depth in range(m, -1, -1):
            rows = ended.filter(F.col("depth") == depth).withColumns(zero).select(columns)
            nodes = level(rows if alive is None else rows.unionByName(alive), depth)
            levels.append(nodes.drop("path"))
            one = F.lit(1).cast("long").alias("children")
            alive = nodes.select(shorter("path").alias("path"), "conv", "n", one, "leaves", "saved")
    else:
        levels.append(turns.sparkSession.createDataFrame([], NODE))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    ends = end_digests(convs)
    full = with_parents(nodes).join(ends, ["depth", "a", "b"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return full.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )
