"""Benchmark windows in documents: a prefix-filtered join on word shingles, then exact words.

Items are cut into windows of ``window`` consecutive words (a shorter item is one window).
A window that occurs in a text shares all its shingles with it, so one shingle is a necessary
prefix: the rarest over all documents. Documents meet a window only under that shingle. Its
place in the window and in the text fix where the window would begin (positional bound), and
the text must be long enough there (length bound); the words of that stretch, as many as the
window has, are then compared one by one.

Defined results: null and empty texts have no words; items without words have no windows;
without items nothing is hit. Items with a null id hit words but are not named. Repeated rows
each get the result of their text. Extra columns pass through; columns named like results are
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shingle_postings import plain, postings, shingle_hashes, split_words
from veilspark.llm.storage import BROADCAST_BYTES, free_names, kept, small_side, text_key

RESULTS = ("n_words", "n_hit", "items", "contaminated")


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``(wid, length, body, items, size, words)`` of the distinct windows; ``body`` joins the words by blanks."""
    words = items.select(F.col("item_id").cast("string").alias("item"), split_words(plain(F.col("text"))).alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    each = words.filter("size(all) > 0").select("item", "all", F.explode(starts).alias("at"))
    each = each.select("item", F.slice("all", F.col("at") + 1, window).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.array_join("words", " ").alias("body"),
        "items",
        F.size("words").alias("length"),
        F.least(F.size("words"), F.lit(shingle)).alias("size"),
        "words",
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside a window), ``items`` (sorted ids) and ``contaminated``."""
    docs = docs.drop(*RESULTS)
    windows = kept(item_windows(items, window, shingle), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [shingle]
    tiles = None
    for size in sizes:
        own = windows.filter(F.col("size") == size)
        part = own.select("body", "length", "size", "items", F.posexplode(shingle_hashes("words", size)).alias("offset", "h"))
        part = part.filter(F.col("offset") <= F.col("length") - F.col("size"))
        tiles = part if tiles is None else tiles.unionByName(part)
    tiles = kept(tiles, "window-shingles")
    found = postings(docs, tiles, "text", sizes)
    counts = found.groupBy("h").agg(F.sum("copies").alias("c"))
    prefixes = (
        tiles.join(counts, "h", "left")
        .groupBy("body", "length", "size", "items")
        .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "offset")).alias("rarest"))
        .select("body", "length", "size", "items", "rarest.h", "rarest.offset")
    )
    prefixes = small_side(kept(prefixes, "window-prefixes"), 1000)
    places = (
        found.join(prefixes, ["h", "size"])
        .select("k1", "k2", (F.col("pos") - F.col("offset")).alias("start"), "length", "body", "items")
        .filter("start >= 0")
    )
    places = kept(places, "window-places")
    grouped = kept(places.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "length", "body", "items")).alias("places")), "window-texts")
    size = places.agg(F.sum(F.length("body") + F.size("items") * 16 + 64)).first()[0] or 0
    t1, t2 = text_key(F.col("text"))
    k1, k2, at, words, sure = free_names(docs, "k1", "k2", "places", "words", "exact")
    texts = docs.withColumns({k1: t1, k2: t2})
    side = grouped.withColumnsRenamed({"k1": k1, "k2": k2, "places": at})
    # Beyond the bound the texts are shuffled, and cut into words only after that.
    met = texts.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, [k1, k2], "left")
    met = met.withColumn(words, split_words(F.col("text")))
    exact = F.filter(
        at,
        lambda p: (p["start"] + p["length"] <= F.size(words))
        & (plain(F.array_join(F.slice(words, p["start"] + 1, p["length"]), " ")) == p["body"]),
    )
    met = met.withColumn(sure, F.coalesce(exact, F.array().cast(side.schema[at].dataType)))
    hit = F.array_distinct(F.flatten(F.transform(sure, lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))))
    named = F.array_sort(F.array_distinct(F.flatten(F.transform(sure, lambda p: p["items"]))))
    return met.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_hit": F.size(hit).cast("long"),
            "items": named,
            "contaminated": F.size(sure) > 0,
        }
    ).drop(k1, k2, words, at, sure)
