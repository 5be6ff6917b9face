"""Lines that several documents share, kept in one of them only.

Lines are exploded and normalised to a key (blanks stripped at both ends, A-Z lower-cased), the
key is hashed, and distinct documents are counted per hash. Where a key of at least
``min_chars`` code points is found in at least ``min_docs`` documents, all its lines go but those
of the document with the smallest id. Texts are put together again from the positions that stay.

A common line is one row per document until it is counted, and counting combines before the
shuffle. The table of shared keys has one row per key; it is broadcast only if its counted rows
are few, else lines meet it in eight salted shares per key. Nothing of a text is gathered
but the positions it loses. Texts stay where they are if all lost positions are few bytes, else
they are shuffled once.

Defined results: a null or empty text is one empty line, and a null becomes the empty text.
Rows that repeat an id are one document. Rows without an id count together as one document
behind all others. A line that a document repeats counts once there, and goes or stays each
time. Extra columns pass through; columns named like results are replaced. Without
documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shingle_postings import plain
from veilspark.llm.storage import BROADCAST_BYTES, kept

BLANKS = " \t\n\x0b\x0c\r"
RESULTS = ("n_lines", "n_dropped")
SALTS = 8


def line_list(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line as it is compared."""
    return plain(F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(id, t, pos, h1, h2)`` of the lines long enough of ``docs(id, text)``; ``t`` hashes the text."""
    # The text is hashed before its lines are exploded, once and not for every line.
    whole = docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), line_list(F.col("text")).alias("lines"))
    each = whole.select("id", "t", F.posexplode("lines").alias("pos", "line"))
    keys = each.select("id", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """``(h1, h2, owner)`` of the keys in at least ``min_docs`` documents. A written table."""
    once = lines.select("h1", "h2", "id").distinct()
    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("id").alias("owner"))
    return kept(counted.filter(F.col("docs") >= max(min_docs, 2)).select("h1", "h2", "owner"), "shared-lines")


def losing(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """The lines of shared keys outside the documents that own them."""
    if shared.count() * 48 <= BROADCAST_BYTES:
        met = lines.join(F.broadcast(shared), ["h1", "h2"])
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("t", "pos"), F.lit(SALTS)).cast("int")
        met = lines.withColumn("salt", own).join(salted, ["h1", "h2", "salt"])
    return met.filter(~F.col("id").eqNullSafe(F.col("owner")))


def without_shared_lines(
    docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with what stays of each text, ``n_lines`` before and ``n_dropped`` (long)."""
    docs = docs.drop(*RESULTS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = hashed_lines(texts, min_chars)
    lost = losing(lines, shared_keys(lines, min_docs))
    # Rows of one id and one text lose the same positions, and so do texts of one id with equal hashes.
    lost = kept(lost.groupBy("id", "t").agg(F.collect_set("pos").alias("lost")), "lost-lines")
    bytes_lost = lost.agg(F.sum(64 + 8 * F.size("lost") + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)))).first()[0] or 0
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("t").alias("lost_t"), "lost")
    lost = F.broadcast(lost) if bytes_lost <= BROADCAST_BYTES else lost.hint("shuffle_hash")
    met = rows.join(lost, F.col(f"row.`{id_col}`").eqNullSafe(F.col("lost_id")) & (F.col("t") == F.col("lost_t")), "left")
    met = met.select("row", "lost", line_list(F.col(f"row.`{text_col}`")).alias("lines"))
    met = met.withColumn("stay", F.expr("array_except(sequence(0, size(lines) - 1), coalesce(lost, array()))"))
    text = F.array_join(F.transform("stay", lambda p: F.get("lines", p)), "\n")
    text = F.when(F.col("lost").isNull(), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))).otherwise(text)
    given = [text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    n = F.size("lines")
    return met.select(*given, n.cast("long").alias("n_lines"), (n - F.size("stay")).cast("long").alias("n_dropped"))
