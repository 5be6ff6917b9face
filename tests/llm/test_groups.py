import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_cases import edge_rows, edges, no_docs  # noqa: F401
from veilspark.llm import contamination as C
from veilspark.llm import license_scan as L
from veilspark.llm import pu_toxicity as P
from veilspark.llm import stages, tensored_minhash
from veilspark.llm import words as W
from veilspark.llm.components import smallest_reachable
from veilspark.llm.tensored_minhash import Settings, near_duplicates


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    """Number of shingles and smallest reachable id of every row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def test_word_hashes_follow_the_words():
    texts = ["a B\tc\n\nd  e f", "", None, "x", "É é É", "a b c d e f", " lead and trail "]
    for _, _, data, offsets in W.slices(pa.array(texts)):
        w = W.words_of(data, offsets)
        words = [x for t in texts for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        assert len(words) == len(w.hash) and w.counts.tolist() == [6, 0, 0, 1, 3, 6, 3]
        names = {}
        for x, h in zip(words, w.hash.tolist()):
            assert names.setdefault(x, h) == h
        assert len(set(names.values())) == len(names)
        h, first = W.shingles_of(w)
        assert np.diff(first).tolist() == [2, 0, 0, 1, 1, 2, 1] and h[:2].tolist() == h[4:6].tolist()


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(7, 7), (None, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed):
    """Groups of near copies at all distances around the threshold, and copies."""
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [str(rng.randint(0, 10**6)) for _ in range(rng.choice([3, 8, 60, 200]))]
        for k in range(rng.choice([1, 2, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = str(rng.randint(0, 10**6))
            rows.append((len(rows), " ".join(copy)))
            if k % 4 == 0:
                rows.append((len(rows), "  ".join(copy).replace("1", "1")))
    return rows


def test_near_duplicates_against_brute_force(spark, edge_rows):
    rows = near_copies(1) + [(None if d is None else d + 1000, t) for d, t in edge_rows]
    rng = random.Random(9)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == Counter((d, n, c) for (d, _), (n, c) in zip(rows, brute_groups(rows)))


def test_near_copies_of_one_text_are_listed_in_proportion_to_them(spark, monkeypatch):
    rng, rows, listed = random.Random(1), [], []
    for d in range(500):
        words = [f"w{i}" for i in range(100)]
        for i in rng.sample(range(100), 2):
            words[i] = f"x{d}_{i}"
        rows.append((d, " ".join(words)))
    written = tensored_minhash.kept

    def kept(df, name):
        done = written(df, name)
        listed.extend([done.count()] if name == "near-pairs" else [])
        return done

    monkeypatch.setattr(tensored_minhash, "kept", kept)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for (d, _), (_, c) in zip(rows, brute_groups(rows))}
    assert 0 < sum(listed) < 6 * len(rows)


def test_hot_keys_and_large_sides_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr("veilspark.llm.tensored_minhash.BROADCAST_BYTES", 0)
    monkeypatch.setattr("veilspark.llm.components.BROADCAST_BYTES", 0)
    rows = near_copies(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, Settings(members=3, open_pairs=0)).collect())
    assert got == Counter((d, n, c) for (d, _), (n, c) in zip(rows, brute_groups(rows)))
    # However few pairs may be compared outright, rounds of pivots find the same.
    few = near_duplicates(df, Settings(open_pairs=0)).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, few.collect())) == got
    kept = near_duplicates(df).filter("doc_id is not null")
    assert kept.filter("kept <> (doc_id = component_id)").count() == 0


def test_no_documents(no_docs, spark):
    assert near_duplicates(no_docs).count() == 0
    assert C.contamination(no_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert L.license_notices(no_docs).count() == 0
    assert P.toxicity(no_docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_stage_keeps_one_row_of_each_group(spark, edges, tmp_path):
    rows = edges.select("doc_id", "text").collect()
    stay = stages.one_of_each_group(spark, edges, "")
    assert stay.columns == edges.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in stay.collect())
    # 2 is a near copy of 1, 8 of 7, and 9 is there twice; texts without words all stay.
    assert got == sorted((d is not None, d or 0) for d in (1, 3, 4, 5, None, 7, 9, 10, 11))
    assert len(rows) == 12


def brute_contamination(docs, items, window=10):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    named |= {str(i) for i in found if i is not None}
        out.append((d, len(w), len(hit), ",".join(sorted(named)), bool(hit)))
    return Counter(out)


def test_contamination_against_brute_force(spark, edges, edge_rows):
    rng = random.Random(2)
    few = ["the", "of", "Éa", "éa", "b2", "Über", "x"]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 14])))) for i in range(25)]
    items += [(None, "the the the of"), (99, None), (98, "--- !!"), (25, items[0][1]), (100, "A row: without (an) ID and some words in it!")]
    # A capital sigma is lower-cased by its place in a word, which depends on the text around it.
    items += [(101, "ΛΟΓΟΣ.Α bb cc"), (102, "ΛΟΓΟΣ.Α bb cc dd ee ff gg hh ii jj kk"), (103, "ΟΔΟΣ'ς ΣΑΣ")]
    docs = [*edge_rows, (500, "ΛΟΓΟΣ.Α bb cc dd ee ff gg hh ii jj kk"), (501, "x ΟΔΟΣ'ς:ΣΑΣ.Σ y"), (502, "λογοσ.α bb cc λογος.Α bb cc")]
    for i in range(60):
        words = [rng.choice([*few, "zz", "QQ"]) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            words[5:5] = (rng.choice(items[:25])[1] or "").upper().replace("ÉA", "Éa").replace("ÜBER", "Über").split()
        docs.append((1000 + i, rng.choice([" ", ", ", "\n"]).join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_hit": F.lit(1), "places": F.lit("x"), "body": F.lit(0)})
    found = C.contamination(df.repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in found.collect())
    assert got == brute_contamination(docs, items)
    none = C.contamination(edges, spark.createDataFrame([], "item_id long, text string"))
    assert set(edges.columns) - {"items"} <= set(none.columns) and none.filter("__k1 is not null or __words is not null").count() == 0
    assert none.filter("contaminated or n_hit > 0").count() == 0 and none.count() == len(edge_rows)


def brute_licenses(text, share=0.75):
    words = L.word_list(text or "")
    names, best = set(), 0.0
    for t in L.NOTICES:
        w = L.word_list(t.text)
        size = min(5, len(w))
        need = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        c = L.length_class(len(w))
        for start in range(0, len(words), c // 4):
            part = words[start : start + c + c // 4]
            have = {tuple(part[i : i + size]) for i in range(len(part) - size + 1)}
            if len(need & have) >= share * len(need):
                names.add(t.license)
                best = max(best, len(need & have) / len(need))
    return ",".join(sorted(names)), round(best, 9)


def test_licenses_against_brute_force(spark, edge_rows):
    rng = random.Random(4)
    docs = list(edge_rows)
    for i in range(80):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
        notice = rng.choice(L.NOTICES).text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            notice[rng.randrange(len(notice))] = "changed"
        at = rng.randint(0, len(words))
        docs.append((1000 + i, " ".join(words[:at] + notice + words[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("best", F.lit("x"))
    found = L.license_notices(df.repartition(3)).collect()
    got = Counter((r.doc_id, ",".join(r.licenses), round(r.best, 9)) for r in found)
    assert got == Counter((d, *brute_licenses(t)) for d, t in docs)
    exact = next(r for r in found if r.doc_id == 1000 + next(i for i in range(80) if brute_licenses(docs[12 + i][1])[1] == 1.0))
    assert all(0 <= s.start < s.end for s in exact.spans) and exact.spans
    assert L.license_notices(df, []).filter("best > 0").count() == 0


def test_notices_that_differ_in_a_word_are_told_apart(spark):
    gnu = "This {0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{3} either version {2} of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
    third = "* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    cases = [
        (gnu.format("program", "", "2", ";"), "GPL-2.0"),
        (gnu.format("program", "", "3", ","), "GPL-3.0"),
        (gnu.format("library", "Lesser ", "2.1", ";"), "LGPL-2.1"),
        (gnu.format("library", "Library ", "2", ";"), "LGPL-2.0"),
        (gnu.format("program", "Lesser ", "3", ","), "LGPL-3.0"),
        (gnu.format("program", "Affero ", "3", ","), "AGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        (bsd.format(""), "BSD-2-Clause"),
        (bsd.format(third), "BSD-3-Clause"),
        ("Permission is hereby granted. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "EPL-2.0"),
        (gnu.format("program", "", "2", ";") + " some other words between the two " * 4 + gnu.format("program", "", "3", ","), "GPL-2.0,GPL-3.0"),
    ]
    df = spark.createDataFrame([(i, "x y z " + t + " and so on") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = L.license_notices(df, L.NOTICES + L.FURTHER).collect()
    assert {r.doc_id: ",".join(r.licenses) for r in found} == {i: want for i, (_, want) in enumerate(cases)}
    for r in found:  # no span of a licence lies inside a longer one of it
        for x in r.spans:
            assert not any(y != x and y.license == x.license and y.start <= x.start and x.end <= y.end for y in r.spans)


def test_bands_promise_a_high_collision_probability():
    for c in (8, 16, 32, 64, 256):
        bands = L.class_bands(c, 5, 0.75, 1e-6)
        worst = min(math.ceil(0.75 * t) / (c + c // 4 - 4 + t - math.ceil(0.75 * t)) for t in range(1 if c == 8 else c // 2 - 3, c - 3))
        assert (1 - worst) ** bands < 1.001e-6 and bands < 200


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["zqidiot", "zqloser", "zqscum", "zqtrash"]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus(3000, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "zqidiot zqloser zqscum"), (9001, None), (9002, "")], "doc_id long, text string")
    docs = docs.withColumns({"positive": F.lit(0), "feature": F.lit("x"), "score": F.lit("y")})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in P.toxicity(docs, labels).withColumn("out", P.fold(3) == 1).collect()}
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].out]
    assert sum(p for p, y in out if y) >= 0.95 * sum(y for _, y in out)
    assert sum(p for p, y in out if not y) <= 0.01 * sum(1 - y for _, y in out)
    assert got[None].predicted == 1 and got[9001].score == got[9002].score and got[9001].predicted == 0
    # Labels of the held-out fold change nothing.
    flipped = labels.withColumn("toxic", F.when(P.fold(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in P.toxicity(docs, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-12 for i in got)


def test_toxicity_without_labels(spark, edges):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert P.toxicity(edges, none).filter("score <> 0 or predicted <> 0").count() == 0


def test_tasks_hold_little_beside_their_texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    model = P.Model(np.ones(1 << 18, dtype=np.float32), 0.0, P.Settings())
    steps = [
        lambda: list(tensored_minhash._signatures(Settings(), iter([batch]))),
        lambda: sum(1 for _ in tensored_minhash._sets(Settings(), iter([batch.select(["text"])]))),
        lambda: P.score_texts(batch.column("text"), model),
    ]
    for step in steps:
        W._powers.clear()
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 << 20
