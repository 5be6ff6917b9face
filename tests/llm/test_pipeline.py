"""The pipeline on a small corpus, stage by stage against plain Python."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from llm_cases import edge_rows, edges, no_docs  # noqa: F401
from test_groups import brute_contamination, brute_groups
from tokenizers import Tokenizer

from veilspark.llm import secret_tags as S
from veilspark.llm.pu_toxicity import toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.kept(stage(spark, tables[-1], SMALL), f"test-{name}"))
    return tables


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def test_stages_against_plain_python(spark, stages_run):
    start, clean, single, apart, masked, last = map(by_id, stages_run)
    for df in stages_run[1:5]:
        assert df.columns == stages_run[0].columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = {r.doc_id: r.predicted for r in toxicity(stages_run[0], labels).collect()}
    assert set(clean) == {i for i in start if not judged[i]} and len(clean) >= 0.8 * len(start)

    rows = [(i, clean[i].text) for i in clean]
    groups = brute_groups(rows)
    assert set(single) == {i for (i, _), (n, c) in zip(rows, groups) if not n or i == c}

    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d: bad for d, _, _, _, bad in brute_contamination([(i, r.text) for i, r in single.items()], items)}
    assert set(apart) == {i for i in single if not held[i]} and all(apart[i].text == start[i].text for i in apart)

    assert set(masked) == set(apart)
    for i, r in masked.items():
        spans = S.base_spans(apart[i].text or "")
        assert (r.text == apart[i].text) == (not spans) or "[SECRET]" in r.text
        assert not S.base_spans(r.text) and r.n_chars == (len(r.text) if r.text != apart[i].text else apart[i].n_chars)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(last) == set(masked)
    for i, r in last.items():
        ids = library.encode(masked[i].text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(masked[i].text.encode()).hexdigest()


def test_stages_on_odd_rows(spark, edges, edge_rows):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like results of the operators."""
    extra = {c: F.lit("x") for c in ("score", "predicted", "spans", "n_hit", "contaminated", "__k1", "__score", "group_id")}
    docs = edges.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        done = corpus_pipeline.kept(stage(spark, docs, SMALL), f"odd-{name}")
        assert done.columns == docs.columns
        assert [f.dataType for f in done.schema] == [f.dataType for f in docs.schema], name
        assert done.filter(" or ".join(f"{c} <> 'x' or {c} is null" for c in extra)).count() == 0
        docs = done
    left = [(r.doc_id, r.text) for r in docs.collect()]
    # 2 repeats the words of 1, 8 nearly those of 7, and one row of 9 stays; texts without words all stay.
    assert sorted((i for i, _ in left if i is not None)) == [1, 3, 4, 5, 7, 9, 10, 11] and (None, edge_rows[5][1]) in left
    assert dict(left)[3] is None and dict(left)[4] == "" and "[SECRET]" in dict(left)[10]
    last = encoded_rows(corpus_pipeline.STAGES[4][1](spark, docs, SMALL))
    assert last[3] == last[4] == 0 and last[7] > 30_000


def encoded_rows(df):
    return {r.doc_id: r.n_tokens for r in df.collect()}


def test_stages_without_documents(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SMALL).count() == 0


def test_registered_queries():
    import __spark_entry__ as entry

    from veilspark.llm.catalog import ORACLE, QUERIES

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
