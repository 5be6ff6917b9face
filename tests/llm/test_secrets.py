import random
import re

import numpy as np

from llm_cases import edge_rows, edges, no_docs  # noqa: F401
from veilspark.llm import secret_tags as S


def brute(text):
    """Base spans, one character at a time."""
    out = []
    for kind, pattern, fits in (
        ("assign", S.ASSIGN, lambda m: len(m[2]) >= 8),
        ("access", S.ACCESS, lambda m: m.end() - m.start() >= 16),
        ("hex", S.HEX, lambda m: m.end() - m.start() >= 32),
    ):
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m:
                out += [(kind, m.start(), m.end())] * fits(m)
                at = m.end()
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_base_spans_against_brute_force():
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", ": ", "=", " = \"", "'", "abcdef01" * 4, "AKIA", "ABCDEF123456", " ", "\n", "é", "ſecret", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert S.base_spans(text) == brute(text), text


def windows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8))) for _ in range(21)]
        tags = [0] * 21
        if i % 2:
            words[9] = "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18))
            tags[9] = 1
        rows.append((words, tags, list(S.file_traits(words, " ".join(words)))))
    return rows


def full_path(tagger, e):
    best, back = tagger.crf.first + e[0], []
    for x in e[1:]:
        ways = best[:, None] + tagger.crf.moves
        back.append(ways.argmax(0))
        best = ways.max(0) + x
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_field_learns_and_decoding_is_that_of_the_full_recursion():
    crf = S.learn(windows(400, 1), S.Settings())
    tagger = S.Tagger(crf)
    for words, tags, _ in windows(200, 2):
        text = " ".join(words)
        got = np.zeros(len(words), dtype=int)
        for at, some in tagger.tags(words, text):
            got[at : at + len(some)] = some
        assert got.tolist() == full_path(tagger, tagger.scores(words, text))
        assert got.tolist() == tags
    # A shorter value than the base pattern takes is still tagged.
    rng = random.Random(4)
    text = " ".join(windows(1, 9)[0][0]) + " password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18))[:16]
    assert S.tagged_spans(text, tagger, [])
    random_field = S.Crf(np.random.default_rng(1).normal(0, 2, crf.weights.shape), np.random.default_rng(2).normal(0, 2, (3, 3)), np.zeros(3), crf.context, crf.settings)
    tagger = S.Tagger(random_field)
    for words, _, _ in windows(100, 3):
        text = " ".join(words)
        got = np.zeros(len(words), dtype=int)
        for at, some in tagger.tags(words, text):
            got[at : at + len(some)] = some
        assert got.tolist() == full_path(tagger, tagger.scores(words, text))


def test_edge_cases(spark, edges, no_docs):
    assert S.fit(no_docs) is None
    found = S.find_secrets(edges, S.fit(edges))
    assert found.columns == [c for c in edges.columns if c != "spans"] + ["spans"]
    rows = {(r.doc_id, r.text): r.spans for r in found.collect()}
    assert rows[(3, None)] == [] and rows[(4, "")] == []
    assert [s.kind for s in rows[next(k for k in rows if k[0] == 10)] if s.kind != "tagged"] == ["assign", "access"]
    assert S.find_secrets(no_docs, None).count() == 0
    masked = S.find_secrets(edges, None, masked=True)
    text = next(r.text for r in masked.collect() if r.doc_id == 10)
    assert text.endswith("[SECRET]' [SECRET]") and "abcdefgh" not in text
    assert masked.filter("doc_id = 7").first().text == edges.filter("doc_id = 7").first().text


def test_mask_of_overlapping_spans():
    assert S.mask("0123456789", [("a", 1, 4), ("b", 3, 6), ("c", 3, 4), ("d", 8, 9)]) == "0[SECRET]67[SECRET]9"
    assert re.sub(r"\[SECRET\]", "", S.mask("ab", [("a", 0, 2)])) == ""


def test_rare_secrets_are_learnt_wherever_they_are(spark):
    """One text in 10,000 holds a secret, none of them among those with the smallest hashes of their ids."""
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(30_000).orderBy(F.desc(F.xxhash64("id"))).limit(3).collect()]
    secret = F.concat(F.lit("see the note password="), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 18), F.lit(" and go on"))
    text = F.when(F.col("id").isin(ids), secret).otherwise("nothing to see here, move along")
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    crf = S.fit(docs.repartition(4))
    assert crf is not None
    again = S.fit(docs.repartition(7))
    assert np.array_equal(crf.weights, again.weights) and crf.context == again.context


def test_one_text_does_not_fill_the_sample():
    import pyarrow as pa

    many = " ".join(f"word password=abcdef{i:06d}" for i in range(500))
    texts = [many] + [f"some text token=zyxwvuts{i}" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(501), pa.int64()), pa.array(texts)], names=["order", "text"])
    [got] = S._windows(S.Settings(windows=100), [batch])
    marked = [o for m, o in zip(got.column("marked").to_pylist(), got.column("order").to_pylist()) if m]
    assert len(marked) == 100 and 20 < sum(o > 0 for o in marked) < 80
