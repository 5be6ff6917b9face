"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import BROADCAST_BYTES, discard, kept


def smallest_reachable(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the smallest node reachable.

    Each round moves links twice: from a node to its larger neighbours, they go to the smallest
    node it knows; then from a node to its smaller neighbours, they go to the smallest of
    these. Links never grow in number, and paths shrink by a factor each round. Only links are
    shuffled; each round is a written table. A null end is no node. After at most ``rounds``
    rounds, if given, nodes of one root are connected, but not all that are connected need
    have one root.
    """
    now = kept(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "components",
    )
    done = 0
    while rounds is None or done < rounds:
        few = 2 * now.count() * 16 <= BROADCAST_BYTES
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = now.join(F.broadcast(low) if few else low, "a").select(F.col("low").alias("a"), "b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(F.broadcast(least) if few else least, "b")
        small = small.select("m", F.explode(F.array("a", "b")).alias("b")).filter("m <> b")
        step = kept(small.select(F.col("m").alias("a"), "b").distinct(), "components")
        # Done when every node hangs on one root and no root hangs on another.
        ends = step.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            step.select(F.col("a").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        )
        open_ends = ends.groupBy("node").agg((F.sum("hangs") + F.max("holds")).alias("ways"), F.max("hangs").alias("h"))
        open_ends = open_ends.filter("h = 1 and ways > 1").limit(1).count()
        discard(now)
        now, done = step, done + 1
        if not open_ends:
            break
    known = now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")))
    return known.groupBy("node").agg(F.min("root").alias("root"))
