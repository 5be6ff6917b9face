"""Where the word shingles of a small table occur in the texts of a large one, in Spark SQL.

Words are runs of letters a-z, digits and non-ASCII characters once A-Z is lower-cased. Other
letters keep their case on both sides: lower-casing them may depend on their neighbours (a Greek
capital sigma), so a word alone and the same word in a text could differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import kept, small_side, text_key

BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def plain(text: Column) -> Column:
    """A-Z lower-cased, nothing else. ASCII texts take the faster of two equal ways."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shingle_hashes(words: str, size: int) -> Column:
    """A hash of the ``size`` words from each word of the array column ``words`` on.

    The last ``size - 1`` entries cover fewer words.
    """
    following = "".join(f", get({words}, i + {k})" for k in range(1, size))
    return F.expr(f"transform({words}, (w, i) -> xxhash64(w{following}))")


def postings(docs: DataFrame, wanted: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """``(k1, k2, size, pos, h, copies)``: places in distinct texts where a shingle of ``wanted(h)`` begins.

    ``k1, k2`` name the text, ``copies`` counts the rows that have it. A written table.
    """
    k1, k2 = text_key(F.col(text_col))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), split_words(plain(F.col(text_col))).alias("words"))
    small = small_side(kept(wanted.select("h").distinct(), "shingles"), 16)
    parts = [
        texts.select("k1", "k2", F.lit(size).alias("size"), F.posexplode(shingle_hashes("words", size)).alias("pos", "h")).join(small, "h")
        for size in sizes
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return kept(found.groupBy("k1", "k2", "size", "pos", "h").agg(F.count("*").alias("copies")), "postings")
