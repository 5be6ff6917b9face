"""The stages of the corpus pipeline: each applies one operator and lets its decisions take effect.

Defined results, in every stage: a null text is an empty one where it is read and stays null where it
is passed on; its toxicity is that of no words, it is in no group, holds no window and no secret, and has
no tokens. Rows without an id or with a repeated one are judged by their texts like any other; only near-duplicate
groups keep one row of what repeats an id and a text. A score of 0.7 is toxic. Texts of any length are
read whole. Without documents, labels or benchmark items a stage drops nothing, and without documents its
result is empty. Extra columns pass through, whatever their names, but for the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.contamination import RESULTS, contamination
from veilspark.llm.prefix_bpe import encode_texts
from veilspark.llm.pu_toxicity import toxicity
from veilspark.llm.secret_tags import find_secrets, fit
from veilspark.llm.storage import free_names, kept, small_side, text_key
from veilspark.llm.tensored_minhash import near_duplicates

VOCABULARY = "byte_bpe_50k.json"


def _set_aside(docs: DataFrame, *results: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns named like an operator's results renamed, and how to get all columns back."""
    clashing = [c for c in docs.columns if c.lower() in results]
    names = dict(zip(clashing, free_names(docs, *clashing)))
    return docs.withColumnsRenamed(names), lambda df: df.select([F.col(names.get(c, c)).alias(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held, back = _set_aside(docs, "score", "predicted")
    return back(toxicity(held, labels).filter("predicted = 0"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Texts without words belong to no group and stay. Of repeated rows of the id that stays,
    one is kept; in a group without ids, one row of the smallest text hash is.
    """
    groups = near_duplicates(docs, with_keys=True)
    row = ["doc_id", "t1", "t2"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *row)).alias("best")
    stay = groups.filter("n_shingles > 0").groupBy("group_id").agg(best).select("best.doc_id", "best.t1", "best.t2")
    rows = groups.groupBy("n_shingles", *row).agg(F.count("*").alias("rows"))
    in_group = [rows["doc_id"].eqNullSafe(stay["doc_id"]), rows["t1"] == stay["t1"], rows["t2"] == stay["t2"]]
    staying = rows.filter("n_shingles > 0").join(stay, in_group, "left_semi")
    keys = kept(
        staying.unionByName(rows.filter("n_shingles = 0").withColumn("rows", F.lit(1).cast("long")))
        .select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "rows"),
        "staying",
    )
    t1, t2 = text_key(F.col("text"))
    k1, k2 = free_names(docs, "k1", "k2")
    keyed = docs.withColumns({k1: t1, k2: t2})

    def those(of: DataFrame) -> DataFrame:
        of = small_side(of, 32)
        on = [keyed["doc_id"].eqNullSafe(of["__id"]), keyed[k1] == of["__t1"], keyed[k2] == of["__t2"]]
        return keyed.join(of, on, "left_semi")

    result = those(keys.filter("rows = 1")).select(docs.columns)
    repeated = keys.filter("rows > 1")
    if repeated.limit(1).count():
        result = result.unionByName(those(repeated).dropDuplicates(["doc_id", k1, k2]).select(docs.columns))
    return result


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held, back = _set_aside(docs, *RESULTS)
    return back(contamination(held, items).filter("not contaminated"))


def with_secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and ``n_chars`` counted anew there."""
    held, back = _set_aside(docs, "spans")
    found = find_secrets(held, fit(held), masked=True)
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return back(found.withColumn("n_chars", n_chars))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the decoded text."""
    return encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY), with_ids=True)
