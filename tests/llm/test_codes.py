"""Codes by bitmasks, shared lines and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import CLASHING
from pyspark.sql import functions as F

from veilspark.llm import line_dedup, part_codes, prefix_trie
from veilspark.llm.line_dedup import without_shared_lines
from veilspark.llm.part_codes import Codebook, Settings, compress
from veilspark.llm.prefix_trie import prefix_trie as trie_of
from veilspark.llm.prefix_trie import rebuilt, turn_lists

BLANKS = " \t\n\x0b\x0c\r"


def with_clashes(df, *more):
    extra = [c.split() for c in CLASHING.split(", ")] + [(n, "int") for n in more]
    return df.withColumns({n: F.lit(None).cast(k) for n, k in extra if n not in df.columns})


# Codes


def brute_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) * scale < 1 << 27 for x in r[1])]
    good = [(i, [math.floor(scale * np.float32(x).astype(float)) for x in v], label) for i, v, label in good if len(v) % parts == 0]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // parts if good else 0
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [nearest(c[p], book)[1] for c in cut]
            moved = []
            for i, e in enumerate(book):
                mine = [c[p] for c, o in zip(cut, own) if o == i]
                moved.append([sum(col) // len(mine) for col in zip(*mine)] if mine else e)
            new.append(moved)
        books = new
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    out = [(i, bytes(e for _, e in f), sum(d for d, _ in f), label) for (i, _, label), f in zip(good, found)]
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted([(i, c, e, label, sums[label]) for i, c, e, label in out], key=repr), books


def test_candidates_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    for n in (1, 2, 16, 64):
        entries = rng.integers(-40, 40, (n, 5))
        entries[n // 2 :] = entries[: n - n // 2]  # equal entries tie
        x = rng.integers(-60, 60, (500, 5))
        book = Codebook(entries)
        squares = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        mask = book.candidates(x)
        least = squares.min(axis=1)
        for row in range(len(x)):
            for e in np.flatnonzero(squares[row] == least[row]):
                assert int(mask[row]) >> int(e) & 1
        index, distance = book.nearest(x)
        assert (index == squares.argmin(axis=1)).all() and (distance == least).all()
    # The masks rule entries out, not only in.
    entries = np.arange(64)[:, None] * np.full((1, 4), 1000)
    assert all(bin(int(m)).count("1") < 4 for m in Codebook(entries).candidates(entries + 3))


def test_codes_against_plain_python(spark):
    rng = random.Random(7)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(None, [0.5] * 16, 1), (5, [0.25] * 16, 0), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    rows += [(500, None, 1), (501, [], 1), (502, [0.1] * 15 + [None], 1), (503, [nan] * 16, 1), (504, [0.1] * 15 + [-inf], 2)]
    rows += [(505, [0.1] * 12, 1), (506, [0.1] * 24, 1), (507, [1e30] + [0.0] * 15, 1), (508, [0.0] * 16, 9), (509, [-0.0] * 16, 9)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "id", "x", "code", "error", "of")
    coded, books = compress(df)
    want, want_books = brute_codes(rows)
    assert sorted([(r.id, bytes(r.code), r.error, r.label, r.label_error) for r in coded.collect()], key=repr) == want
    assert books.tolist() == want_books


def test_codes_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(3, [0.5] * 8, None), (1, [0.25] * 8, None)]
    coded, books = compress(spark.createDataFrame(rows, schema))
    assert sorted([(r.id, bytes(r.code), r.error, r.label, r.label_error) for r in coded.collect()], key=repr) == brute_codes(rows)[0]
    assert books.shape == (8, 2, 1)
    none, books = compress(spark.createDataFrame([], schema), Settings(rounds=2))
    assert books is None and none.collect() == [] and none.columns == ["id", "label", "code", "error", "label_error"]


def test_a_shared_label_side_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(part_codes, "small_side", lambda df, _: df)
    rows = [(i, [i / 50] * 8, i % 3 or None) for i in range(40)]
    coded, _ = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted([(r.id, bytes(r.code), r.error, r.label, r.label_error) for r in coded.collect()], key=repr) == brute_codes(rows)[0]


# Lines


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def brute_lines(rows, min_chars=10, min_docs=2):
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: ascii_lower(line.strip(BLANKS))
    holders = {}
    for i, lines in cut:
        for line in lines:
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, lines in cut:
        stay = []
        for line in lines:
            who = holders[key(line)]
            lost = len(key(line)) >= min_chars and len(who) >= min_docs and i != min(who, key=lambda x: (x is None, x or 0))
            stay += [] if lost else [line]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


LINES = [
    (1, "A shared line of text\n\tonly here, in one place \n\n short\nA shared line of text"),
    (2, "  a SHARED line of TEXT\r\nshort\nsomething else entirely"),
    (None, "a shared line of text\nwithout an id, first row"),
    (None, "without an id, first row\nwithout an id, second row"),
    (4, None),
    (5, ""),
    (6, "\n\n\n"),
    (7, "ÄÖÜ in capital letters\nnine char\nten  chars"),
    (8, "äöü in capital letters\nNINE CHAR\nTEN  CHARS"),
    (9, "ÄÖÜ IN capital letters"),
    (9, "ÄÖÜ IN capital letters"),
    (9, "ÄÖÜ IN capital letters\nten  chars\n\xa0ten  chars"),
    (10, "x" * 9 + "漢\n" + "x" * 8 + "漢"),
    (11, "x" * 9 + "漢\n" + "x" * 8 + "漢"),
    (12, "a line from the long text 7\na line from the long text 7"),
    (13, "\n".join(f"a line from the long text {i % 4_000}" for i in range(5_000))),
    (-3, "something else entirely \x00"),
    (14, "something else entirely \x00\nsomething else entirely\x0b"),
]


@pytest.mark.parametrize("broadcast, min_docs", [(True, 2), (False, 2), (False, 3)])
def test_lines_against_plain_python(spark, monkeypatch, broadcast, min_docs):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    df = with_clashes(spark.createDataFrame(LINES, "doc_id long, text string"), "row", "t", "lost", "lines", "stay", "n_lines", "owner", "id")
    done = without_shared_lines(df, min_docs=min_docs)
    assert [c for c in done.columns if c not in ("n_lines", "n_dropped")] == [c for c in df.columns if c != "n_lines"]
    rows = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done.collect()]
    assert sorted(rows, key=repr) == brute_lines(LINES, min_docs=min_docs)


def test_texts_are_not_shuffled_for_few_lost_lines(spark):
    rows = [(d, f"a line of all texts\nown line {d} of {d}\n") for d in range(20)]
    done = without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.text) for r in done.collect()} == {(d, t if d == 0 else t.split("\n", 1)[1]) for d, t in rows}


def test_no_documents_no_lines(spark):
    done = without_shared_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert done.collect() == [] and done.columns == ["doc_id", "text", "n_lines", "n_dropped"]


# Trie


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
            saved[path[:d]] = saved.get(path[:d], 0) + own
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        row = (min(members), len(path), parent, len(members), kids.get(path, 0), leaves[path], saved[path])
        out.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_of(rng, c, n):
    return [(c, i, rng.choice(["user", "assistant"]), rng.choice(["hello there", "a b  c\td", "", "x"])) for i in range(n)]


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 130), -1, -20, -25]:
        rows += turns_of(rng, c, rng.randint(1, 6))
    for c in (200, 201, 202, 221, 403, 404, 405):  # 220 and 400 are absent: some are left without a turn
        rows += [(c, 0, "user", "hello there")]
    for c in range(600, 640):  # deep ones with a common beginning
        rows += [(c, i, "user", f"turn {i if i < 5 + c % 7 else i * c}") for i in range(14 + c % 5)]
    rows += [(700, i, "user", f"word {i}") for i in range(60)]
    rows += [(801, None, None, None), (801, 0, "user", "b"), (801, 0, "user", "a"), (801, None, "user", "z"), (801, 0, "user", "a")]
    rows += [(None, 0, "user", "no conversation"), (802, 3, "ü", "É  漢字\n x"), (2**40, 1, "user", "hello there")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("settings", [prefix_trie.Settings(), prefix_trie.Settings(group_turns=200, depths=2), prefix_trie.Settings(group_turns=0, depths=12)])
def test_trie_against_plain_python(spark, talk, settings):
    rows = [r for r in talk if r[0] != 700] if settings.group_turns == 0 else talk
    df = with_clashes(spark.createDataFrame(rows, SCHEMA), "a", "b", "path", "conv", "base", "t", "h", "depth", "turns")
    made = rebuilt(turn_lists(df))
    want = brute_rebuilt(rows)
    assert {r.conv: len(r.turns) for r in made.collect()} == {c: len(t) for c, t in want.items()}
    assert any(not t for t in want.values())
    assert sorted([tuple(r) for r in trie_of(made, settings).collect()], key=repr) == brute_trie(want)


def test_deep_limit_is_measured(spark, talk):
    made = rebuilt(turn_lists(spark.createDataFrame(talk, SCHEMA)))
    ended = made.select(prefix_trie.placed(F.col("turns")).alias("path"))
    assert prefix_trie.deep_limit(ended, 60, prefix_trie.Settings()) == 8
    assert prefix_trie.deep_limit(ended, 60, prefix_trie.Settings(group_turns=100)) == 16
    assert prefix_trie.deep_limit(ended, 60, prefix_trie.Settings(group_turns=1)) == 60


def test_ends_in_several_runs(spark):
    """A node's ids are joined in runs; the digest is that of all of them in order."""
    ids = sorted(random.Random(1).sample(range(-(2**33), 2**33), 3000))
    df = spark.createDataFrame([(i, 0, "user", "same") for i in ids], SCHEMA)
    made = turn_lists(df).select("conv", "turns")
    leaf = trie_of(made).filter("depth = 1").collect()
    assert len(leaf) == 1 and leaf[0].n_convs == 3000 and leaf[0].saved_tokens == 2999
    assert leaf[0].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_no_conversations_no_nodes(spark):
    for rows in ([], [(None, 0, "user", "x")]):
        assert trie_of(rebuilt(turn_lists(spark.createDataFrame(rows, SCHEMA)))).collect() == []
