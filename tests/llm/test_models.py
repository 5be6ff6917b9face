import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import edge_rows, edges, no_docs  # noqa: F401
from veilspark.llm import gated_lm as G
from veilspark.llm import impact_search as I
from veilspark.llm.pu_toxicity import fold


def brute_top(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q, vectors in ok.items():
        if q % 50 == 0:
            for x in vectors:
                scores = [(-sum(a * b for a, b in zip(x, y)), c) for c, ys in ok.items() for y in ys if c != q and len(y) == len(x)]
                out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [I.Settings(), I.Settings(shard_rows=20, block_queries=1), I.Settings(k=40, level_bits=0, fall=0.9, outright=1000)])
def test_top_k_against_brute_force(spark, settings):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, list(rows[7][1])) for i in range(60)]  # ties
    rows += [(400, [0.0] * 8), (450, None), (500, []), (550, [1.0, None] * 4), (600, [math.nan] * 8), (650, [math.inf] * 8), (None, [1.0] * 8)]
    rows += [(700, [1.0, 2.0, -3.0]), (701, [0.5, -0.25, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "shard": F.lit(1)})
    got = I.top_k(df.repartition(4), F.col("id") % 50 == 0, settings)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, settings.k)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert I.top_k(df, F.col("id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert I.top_k(alone, F.col("id") % 50 == 0).count() == 0


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + ["\0end"]


def corpus(n, seed):
    """Texts in two invented tongues: what came before tells what comes next."""
    rng = random.Random(seed)
    tongues = [["".join(rng.choice(a) for _ in range(rng.randint(2, 4))) for _ in range(40)] for a in ("abcd", "wxyz")]
    rows = []
    for i in range(n):
        words = [rng.choice(tongues[i % 2]) for _ in range(rng.randint(0, 60))]
        if i % 5 == 0:
            words.append(f"rare{rng.randint(0, 10**6)}")
        rows.append((i, " ".join(words)))
    return rows


SMALL = G.Settings(frequent=60, units=48, groups=8, classes=8, hidden=8, rounds=4, rate=0.05)


def test_scores_against_counts_and_better_than_them(spark, edge_rows):
    rows = corpus(900, 1) + [(None if d is None else d + 5000, t) for d, t in edge_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "row": F.lit(2), "c": F.lit(3), "base": F.lit(4)})
    got = G.score_texts(df.repartition(3), fold(10) == 0, SMALL).collect()
    assert len(got) == len(rows)
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None}
    counts = Counter()
    for i, t in rows:
        if not out.get(i, False):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[(i, out.get(i, False), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert all(r.score < 0 for r in got)


def test_nothing_to_learn(spark, no_docs):
    assert G.score_texts(no_docs, fold(10) == 0).count() == 0
    df = spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    for r in G.score_texts(df, fold(10) == 0).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def lexicon():
    units, s = 24, G.Settings(units=24, groups=4, classes=4, hidden=5, window=4)
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 50, units).astype(float)
    classes, places = np.arange(units) // 6, np.arange(units) % 6
    outer = np.log(np.bincount(classes, weight))
    inner = np.log(weight).reshape(4, 6)
    hashes = np.arange(20, dtype=np.uint64)
    return G.Lexicon(hashes, np.ones(20, dtype=np.int64), np.arange(20), classes, places, (outer, inner), np.ones(4), np.ones(4), 100, 20, s)


def test_probabilities_sum_to_one():
    model = G.GatedModel.started(lexicon())
    states = np.random.default_rng(2).normal(size=(3, 5)).astype(np.float32)
    total = sum(np.exp(model.log_probabilities(states, np.full(3, u))) for u in range(24))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradients_against_differences():
    lex = lexicon()
    model = G.GatedModel(lex, np.random.default_rng(3).normal(0, 0.3, G.GatedModel(lex).size))
    rng = np.random.default_rng(4)
    given, want = rng.integers(0, 24, (4, 3)), rng.integers(0, 24, (4, 3))
    live = np.ones((4, 3), dtype=bool)
    live[2:, 1] = False
    h = rng.normal(size=(3, 5))
    grad, _, _ = model.train_window(given, want, live, h)
    for at in rng.choice(model.size, 60, replace=False):
        losses = []
        for d in (1e-5, -1e-5):
            moved = model.vector.copy()
            moved[at] += d
            losses.append(G.GatedModel(lex, moved).train_window(given, want, live, h)[2])
        assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-5 / live.sum(), abs=1e-5)


def test_state_carries_across_windows():
    lex = lexicon()
    model = G.GatedModel.started(lex)
    rng = np.random.default_rng(5)
    lengths = [1, 7, 300, 40]
    unit, first = rng.integers(0, 20, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    whole = G.score_units(model, unit, first)
    small = G.GatedModel(G.Lexicon(**{**lex.__dict__, "settings": G.Settings(**{**lex.settings.__dict__, "score_tokens": 3})}), model.vector)
    assert np.allclose(whole, G.score_units(small, unit, first), atol=1e-3)


def test_training_steps_take_live_texts_only():
    lex = lexicon()
    model = G.GatedModel(lex, np.random.default_rng(3).normal(0, 0.3, G.GatedModel(lex).size))
    rng = np.random.default_rng(4)
    live = np.arange(4)[:, None] < np.array([1, 4, 2])
    rows, step = [], model.step
    model.step = lambda x, h, *more: rows.append(len(h)) or step(x, h, *more)
    given, want, h = rng.integers(0, 24, (4, 3)), rng.integers(0, 24, (4, 3)), rng.normal(size=(3, 5))
    grad, last, loss = model.train_window(given, want, live, h)
    assert rows == [3, 2, 1, 1]
    # Cells beyond a text's end change nothing, and an ended text keeps its state.
    given[~live], want[~live] = 0, 0
    again = model.train_window(given, want, live, h)
    assert np.array_equal(grad, again[0]) and np.array_equal(last, again[1]) and loss == again[2]
    for i, n in enumerate((1, 4, 2)):
        alone = model.train_window(given[:n, i : i + 1], want[:n, i : i + 1], live[:n, i : i + 1], h[i : i + 1])
        assert np.allclose(alone[1][0], last[i])


def test_scores_against_plain_arithmetic():
    lex = lexicon()
    model = G.GatedModel(lex, np.random.default_rng(6).normal(0, 0.3, G.GatedModel(lex).size).astype(np.float32))
    p, k = model.p, lex.settings.hidden
    rng = np.random.default_rng(7)
    lengths = [3, 1, 40, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    unit = rng.integers(0, 24, first[-1])
    want = []
    for a, b in zip(first, first[1:]):
        h, before, total = np.zeros(k), 0, 0.0
        for u in unit[a:b]:
            x, g = p["wx"][before] + p["b"], h @ p["wh"]
            z, r = (1 / (1 + np.exp(-(x + g)[i : i + k])) for i in (0, k))
            h = h + z * (np.tanh(x[2 * k :] + r * g[2 * k :]) - h)
            c = lex.classes[u]
            for scores, at in ((h @ p["wc"] + p["bc"], c), (h @ p["wi"][c] + p["bi"][c], lex.places[u])):
                total += scores[at] - np.log(np.exp(scores).sum())
            before = u
        want.append(total)
    assert np.allclose(G.score_units(model, unit, first), want, rtol=1e-4)


def test_words_are_looked_up_as_by_search():
    rng = np.random.default_rng(8)
    lex = lexicon()
    for hashes in (rng.integers(0, 2**64, 5000, dtype=np.uint64), np.arange(40, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64), lex.hashes[:1]):
        of = G.Lexicon(**{**lexicon().__dict__, "hashes": np.unique(hashes)})
        asked = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64)])
        assert np.array_equal(of.places_of(asked), np.searchsorted(of.hashes, asked))
    known, unit, group = G.find(lex, G.W.words_of(np.frombuffer(b"Ab ab aB x", np.uint8), np.array([0, 10])))
    leads = [97 * 256 + 98] * 3 + [120 * 256]
    assert known.tolist() == [-1] * 4 and group.tolist() == G.group_of(np.array(leads), 4).tolist() and unit.tolist() == (20 + group).tolist()


@pytest.mark.parametrize("units", [24, 40_000])
def test_stretches_as_bytes_are_the_same(units):
    lex = G.Lexicon(**{**lexicon().__dict__, "classes": np.zeros(units, dtype=np.int64)})
    rng = np.random.default_rng(9)
    lists = [rng.integers(0, units, n).astype(np.int32) for n in (*rng.integers(2, 30, 2 * G.STRETCH_ROWS + 7), 1025)]
    columns = [pa.array(lists, pa.list_(pa.int32())), pa.array(range(len(lists)), pa.int64()), pa.array([0] * len(lists), pa.int32())]
    batch = pa.RecordBatch.from_arrays(columns, names=["units", "place", "number"])
    for whole in (batch, batch.slice(5, 1300), batch.slice(0, 0)):
        got = list(G._as_bytes(lex, [whole]))
        assert [u.tolist() for b in got for u in G._from_bytes(lex, b.column("units"))] == whole.column("units").to_pylist()
        assert [x for b in got for x in b.column("place").to_pylist()] == whole.column("place").to_pylist()


def test_whole_texts_are_learnt():
    lex = lexicon()
    texts = [" ".join(f"w{i % 37}" for i in range(n)) for n in (0, 1, 31, 32, 33, 700, 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None]), pa.array(range(8), pa.int64())], names=["text", "place"])
    got = [u for b in G._stretches(lex, [batch]) for u in b.column("units").to_pylist()]
    end = int(lex.units[0])
    want = []
    for t in [*texts, ""]:
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        w = G.W.words_of(data, np.array([0, len(data)]))
        want += [*(G.find(lex, w)[1].tolist() if t else []), end]
    assert [u for stretch in got for u in stretch[1:]] == want
    trainer = G.Trainer(G.GatedModel.started(lex), 0.01)
    trainer.read([np.array(u) for u in got])
    assert trainer.tokens == len(want)
