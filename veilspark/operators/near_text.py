"""Pairs of long texts within the allowed number of edits, found by equi-joins.

Two texts whose longer one has ``m`` characters count as similar up to ``m // 10`` edits.
Comparing all values with each other is quadratic, so values meet only under keys that
every similar pair is bound to share:

* one or two edits: both texts minus the same number of characters (a key is shared by
  close texts only, however common their prefix is);
* three edits or more: cut into one piece more than edits allowed, at least one piece
  survives unchanged, shifted by at most that many places.

Every pair that meets is verified with the edit distance itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.relations import shuffled

# Fixed value: one edit in ten characters keeps the similarity at 0.9.
CHARACTERS_PER_EDIT = 10
DELETION_EDITS = 2


def near_text_pairs(left: DataFrame, right: DataFrame, col: str, longest: int, block: str | None = None) -> DataFrame:
    """Distinct pairs ``(lv, rv)``, ``lv != rv``, of values of ``col`` that are similar.

    Both inputs hold the column once per distinct value; ``longest`` bounds the length of
    all values. With ``block`` they hold it once per value and block, and only values of one
    block meet: ``(block, lv, rv)``.
    """
    edits = longest // CHARACTERS_PER_EDIT
    # A value unfolds into many keys, so a few bytes of values are a lot of work: a fixed
    # number of partitions keeps adaptive execution from merging them by size. (Hashing
    # the hash asks for a partitioning that distinct has not left already.)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [] if block is None else [F.col(block).alias("block")]
    lv, rv = (
        _levels(side.select(F.col(col).alias("v"), *own).repartition(parts, F.xxhash64("v")), edits)
        for side in (left, right)
    )
    pairs = _meet(_deletion_keys(lv), _deletion_keys(rv))
    if edits > DELETION_EDITS:
        pairs = pairs.unionByName(_meet(_probe_keys(lv), _piece_keys(rv)))
    # A distance beyond the edits that the longest value allows is -1.
    distance = F.levenshtein("lv", "rv", edits)
    size = F.greatest(F.length("lv"), F.length("rv")).cast("double")
    # Verified before duplicates are dropped: most pairs that meet are not similar.
    similar = pairs.where(F.col("lv") != F.col("rv")).where((distance >= 0) & (1.0 - distance / size >= 0.9))
    return similar.distinct()


def long_text_columns(left: DataFrame, right: DataFrame, cols: list[str]) -> dict[str, int]:
    """Text columns with values on both sides that an edit can be forgiven, and the
    length of the longest value."""
    if not cols:
        return {}
    longest = [F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in cols]
    both = left.agg(*longest).unionByName(right.agg(*longest)).collect()
    shorter = {c: min(row[c] for row in both) for c in cols}
    longer = {c: max(row[c] for row in both) for c in cols}
    return {
        c: longer[c]
        for c in cols
        if shorter[c] >= CHARACTERS_PER_EDIT - 1 and longer[c] >= CHARACTERS_PER_EDIT
    }


def _levels(values: DataFrame, most: int) -> DataFrame:
    """One row per value and number of edits ``k`` it can take part with."""
    size = F.length("v")
    low = F.greatest((size / CHARACTERS_PER_EDIT).cast("int"), F.lit(1))
    high = F.least((size / (CHARACTERS_PER_EDIT - 1)).cast("int"), F.lit(most))
    return (
        values.where(F.col("v").isNotNull() & (size >= CHARACTERS_PER_EDIT - 1))
        .select("*", size.alias("size"), F.explode(F.sequence(low, F.greatest(low, high))).alias("k"))
    )


def _without_one(text):
    return F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(
            F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))
        ),
    )


def _deletion_keys(levels: DataFrame) -> DataFrame:
    text = F.col("v")
    once = _without_one(text)
    twice = F.flatten(F.transform(once, lambda t: _without_one(t)))
    keys = F.when(F.col("k") == 1, F.concat(F.array(text), once)).otherwise(
        F.concat(F.array(text), once, twice)
    )
    return levels.where(F.col("k") <= DELETION_EDITS).select(
        *_own(levels), F.col("k"), F.lit(0).alias("size_r"), F.lit(0).alias("piece"),
        F.explode(F.array_distinct(keys)).alias("key"),
    )


def _piece_bounds(size, k, i):
    """1-based start and length of piece ``i`` of ``k + 1`` even pieces."""
    start = F.floor(i * size / (k + 1)).cast("int")
    end = F.floor((i + 1) * size / (k + 1)).cast("int")
    return start + 1, end - start


def _piece_keys(levels: DataFrame) -> DataFrame:
    rows = levels.where(F.col("k") > DELETION_EDITS).select(
        *_own(levels), "k", F.col("size").alias("size_r"),
        F.explode(F.sequence(F.lit(0), F.col("k"))).alias("piece"),
    )
    start, length = _piece_bounds(F.col("size_r"), F.col("k"), F.col("piece"))
    return rows.withColumn("key", F.substring("v", start, length))


def _probe_keys(levels: DataFrame) -> DataFrame:
    k = F.col("k")
    rows = (
        levels.where(k > DELETION_EDITS)
        .withColumn(
            "size_r",
            F.explode(
                F.sequence(
                    F.greatest(F.col("size") - k, F.lit(1)), F.col("size") + k
                )
            ),
        )
        .where((F.greatest("size", "size_r") / CHARACTERS_PER_EDIT).cast("int") == k)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), k)))
        .withColumn("shift", F.explode(F.sequence(-k, k)))
    )
    start, length = _piece_bounds(F.col("size_r"), k, F.col("piece"))
    # Take the first untouched piece: each piece before it holds an edit, so at most
    # k - piece edits follow it, and the rest of the two texts differ by no more.
    off = F.col("shift")
    lag = F.col("size") - F.col("size_r")
    reachable = F.abs(off - lag) <= k - F.col("piece")
    begin = start + off
    return rows.where(
        reachable & (begin >= 1) & (begin + length - 1 <= F.col("size"))
    ).select(*_own(levels), "k", "size_r", "piece", F.substring("v", begin, length).alias("key"))


def _own(rows: DataFrame) -> list[str]:
    """The value, and its block if there are blocks."""
    return [c for c in ("block", "v") if c in rows.columns]


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs under a common key. Keys are hashes: whoever shares one by accident is not similar."""
    blocks = _own(left)[:-1]
    key = F.xxhash64(*blocks, "k", "size_r", "piece", "key").alias("hash")
    a = left.select(key, *blocks, F.col("v").alias("lv"))
    b = right.select(key, *[F.col(x).alias("other") for x in blocks], F.col("v").alias("rv"))
    met = a.join(shuffled(b), "hash")
    if blocks:
        met = met.where(F.col("block") == F.col("other"))
    return met.select(*blocks, "lv", "rv")
