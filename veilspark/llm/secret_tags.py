"""Secrets in texts: base patterns, and a linear-chain conditional random field beside them.

The field tags blank-separated tokens as secret begin, inside or outside. Features are the
token's shape, the shapes and context words of both neighbours, and traits of the file. It is
trained in numpy on a bounded sample of windows in which the base patterns mark the secrets
(all texts are looked at, and the ``Settings.windows`` windows of each kind with the smallest
hashes are learnt), and decoded by Viterbi over every whole text. A token whose outside score leads by
more than any change of transitions can return is outside in every best path, so only the
runs between such tokens need the recursion; the result is that of the full recursion.

Base spans are always kept; tagged spans are added where they touch none of them.

Defined results: a null or empty text has no spans; without any base span in the texts
nothing is learnt and nothing added. Offsets count code points, ends are exclusive. Repeated
rows get equal spans. Extra columns pass through; a column named ``spans`` is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.storage import in_tasks, kept

# The base patterns. Matches that fail the length are dropped.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "tagged")

OUTSIDE, BEGIN, INSIDE = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    windows: int = 1500  # of each kind: around base spans, and at random
    reach: int = 12  # tokens on either side
    context: int = 300  # words near secrets that are features by themselves
    bits: int = 14  # hashed features
    epochs: int = 60
    rate: float = 0.1
    shrink: float = 1e-4
    looked_at: int = 200  # characters of a token that features look at
    words_kept: int = 500_000  # tokens whose features a Python worker remembers
    seed: int = 7


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if max(map(len, text.split()), default=0) >= 32:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _shape(token: str) -> str:
    """Kinds of characters, runs as one: x lower, X upper, 9 digit, others as they are."""
    out = []
    for c in token:
        k = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:14])


def traits(token: str, context: frozenset[str], looked_at: int) -> tuple[str, ...]:
    """Features of a token by itself."""
    token = token[:looked_at]
    body = token.rstrip(".,;:!?")
    size = min(len(token).bit_length(), 7)
    if body.isalpha() and (body.islower() or body.istitle()):
        word = body.lower()
        return ("plain", f"n{size}", f"w{word}" if word in context else "w", f"e{token[len(body):][:1]}")
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    word = re.split("[=:]", token.lower(), maxsplit=1)[0].strip("\"'")
    return (
        f"s{_shape(token)}",
        f"n{size}",
        f"w{word}" if word in context else "w",
        f"d{min(digits, 9)}",
        f"m{int(digits > 0)}{int(letters > 0)}{int(token.islower())}{int(token.isupper())}",
        f"r{round(4 * digits / len(token))}",
        f"h{int(re.fullmatch('[0-9a-f]{16,}', token.strip(chr(34) + chr(39))) is not None)}",
        f"c{len(set(token)).bit_length()}",
        f"p{token[:4]}" if token[:4].isupper() else "p",
        f"q{int('=' in token)}{int(':' in token)}{int(chr(34) in token)}{int('@' in token)}{int('/' in token)}",
    )


def file_traits(tokens: list[str], text: str) -> tuple[str, ...]:
    """Features of the whole file."""
    marks = sum(text.count(c) for c in "={}()<>|")
    return (f"f{min(len(tokens).bit_length(), 12)}", f"g{min(marks.bit_length(), 6)}", f"k{int(text.isascii())}")


def _index(names: tuple[str, ...], role: str, bits: int) -> list[int]:
    return [zlib.crc32(f"{role}{n}".encode()) & ((1 << bits) - 1) for n in names]


@dataclass(frozen=True)
class Crf:
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # from x to
    first: np.ndarray
    context: frozenset[str]
    settings: Settings


def spans_to_tags(starts: list[int], ends: list[int], spans: list[Span]) -> np.ndarray:
    """Tags of tokens by the spans that touch them."""
    tags = np.zeros(len(starts), dtype=np.int64)
    for _, a, b in spans:
        i = int(np.searchsorted(ends, a, side="right"))
        j = int(np.searchsorted(starts, b, side="left"))
        if i < j and not tags[i]:
            tags[i] = BEGIN
        for t in range(i + 1, j):
            tags[t] = tags[t] or INSIDE
    return tags


def _rank(order: int, number: int) -> int:
    """A hash of a window by its text's ``order`` and its number, so that no text has all small ones."""
    x = (order + (number + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (2**64 - 1)
    return (x ^ (x >> 31)) >> 1


class Smallest:
    """The ``size`` smallest of the rows that are added."""

    def __init__(self, size: int):
        self.size, self.rows, self.last = size, [], None

    def wants(self, rank: int) -> bool:
        return self.last is None or rank <= self.last

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= 2 * self.size:
            self.cut()

    def cut(self) -> list[tuple]:
        self.rows = sorted(self.rows)[: self.size]
        if len(self.rows) == self.size:
            self.last = self.rows[-1][0]
        return self.rows


def _windows(s: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all texts of a task, the windows of each kind with the smallest hashes."""
    found = {True: Smallest(s.windows), False: Smallest(s.windows)}
    for batch in batches:
        for order, value in zip(batch.column("order").to_pylist(), batch.column("text")):
            text = value.as_py() or ""
            spans = base_spans(text)
            at_random = _rank(order, -1)
            if not spans and not found[False].wants(at_random):
                continue
            places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
            if not places:
                continue
            starts, ends = [p[0] for p in places], [p[1] for p in places]
            tags = spans_to_tags(starts, ends, spans)
            of_file = list(file_traits([""] * len(places), text))
            centres = [(_rank(order, int(t)), int(t), True) for t in np.flatnonzero(tags == BEGIN)]
            centres.append((at_random, abs(order) % len(places), False))
            for rank, centre, marked in centres:
                if found[marked].wants(rank):
                    a, b = max(0, centre - s.reach), min(len(places), centre + s.reach + 1)
                    tokens = [text[x:y][: s.looked_at] for x, y in places[a:b]]
                    found[marked].add((rank, order, centre, tokens, tags[a:b].tolist(), of_file))
    rows = [(marked, *r) for marked, some in found.items() for r in some.cut()]
    names = ["marked", "rank", "order", "centre", "tokens", "tags", "of_file"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _forward_backward(e: np.ndarray, live: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Marginals and pair marginals of padded windows ``(n, t, 3)``; ``live`` marks real tokens."""
    n, t, k = e.shape
    alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
    alpha[:, 0] = first + e[:, 0]
    for i in range(1, t):
        step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + moves, axis=1) + e[:, i]
        alpha[:, i] = np.where(live[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = np.logaddexp.reduce(moves + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
        beta[:, i] = np.where(live[:, i + 1, None], step, 0.0)
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    one = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
    pair = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    return one, pair * live[:, 1:, None, None]


def learn(rows: list[tuple[list[str], list[int], list[str]]], s: Settings) -> Crf | None:
    """Fit the field to windows of ``(tokens, tags, file traits)`` by their likelihood."""
    if not any(any(r[1]) for r in rows):
        return None
    near = Counter()
    for tokens, tags, _ in rows:
        marked = np.flatnonzero(tags)
        for i in marked:
            near.update({re.split("[=:]", t.lower(), maxsplit=1)[0].strip("\"'.,;:!?") for t in tokens[max(0, i - 2) : i + 3]})
    context = frozenset(w for w, c in sorted(near.items(), key=lambda x: (-x[1], x[0]))[: s.context] if c > 2 and w)
    width = max(len(r[0]) for r in rows)
    live, gold = np.zeros((len(rows), width), dtype=bool), np.zeros((len(rows), width), dtype=np.int64)
    cell, feature = [], []
    for r, (tokens, tags, of_file) in enumerate(rows):
        live[r, : len(tokens)], gold[r, : len(tokens)] = True, tags
        own = [traits(t, context, s.looked_at) for t in tokens]
        for i in range(len(tokens)):
            f = _index(own[i], "o", s.bits) + _index(tuple(of_file), "f", s.bits)
            f += _index(own[i - 1], "l", s.bits) if i else []
            f += _index(own[i + 1], "r", s.bits) if i + 1 < len(tokens) else []
            cell += [r * width + i] * len(f)
            feature += f
    cell, feature = np.array(cell), np.array(feature)
    size = 1 << s.bits
    w, moves, first = np.zeros((size, 3)), np.zeros((3, 3)), np.zeros(3)
    want = np.eye(3)[gold] * live[:, :, None]
    want_pair = (want[:, :-1, :, None] * want[:, 1:, None, :]).sum((0, 1))
    n = live.sum()
    state = [np.zeros(x.shape) for x in (w, moves, first)], [np.zeros(x.shape) for x in (w, moves, first)]
    for step in range(1, s.epochs + 1):
        e = np.stack([np.bincount(cell, w[feature, k], len(rows) * width) for k in range(3)], axis=-1).reshape(len(rows), width, 3)
        one, pair = _forward_backward(e, live, moves, first)
        gap = (one - want).reshape(-1, 3)
        grads = (
            np.stack([np.bincount(feature, gap[cell, k], size) for k in range(3)], axis=-1) / n + s.shrink * w,
            (pair.sum((0, 1)) - want_pair) / n + s.shrink * moves,
            (one[:, 0] - want[:, 0]).sum(0) / n + s.shrink * first,
        )
        for x, g, m, v in zip((w, moves, first), grads, *state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(w, moves, first, context, s)


class Tagger:
    """Tags whole texts by the best path through the field."""

    def __init__(self, crf: Crf):
        self.crf = crf
        m, first = crf.moves, crf.first
        gains = [m[p, x] + m[x, q] - m[p, 0] - m[0, q] for p in range(3) for x in (1, 2) for q in range(3)]
        gains += [first[x] + m[x, q] - first[0] - m[0, q] for x in (1, 2) for q in range(3)]
        gains += [m[p, x] - m[p, 0] for p in range(3) for x in (1, 2)] + [first[x] - first[0] for x in (1, 2)]
        self.lead = max(gains)
        self.classes: dict[tuple[str, ...], int] = {}
        self.roles: list[np.ndarray] = []
        self.table = np.zeros((0, 3, 3))
        outer = self

        class Known(dict):
            def __missing__(self, token: str) -> int:
                if len(self) >= crf.settings.words_kept:
                    self.clear()
                got = self[token] = outer._class_of(token)
                return got

        self.known = Known()

    def _class_of(self, token: str) -> int:
        names = traits(token, self.crf.context, self.crf.settings.looked_at)
        at = self.classes.get(names)
        if at is None:
            at = self.classes[names] = len(self.roles)
            self.roles.append(np.stack([self.crf.weights[_index(names, r, self.crf.settings.bits)].sum(0) for r in "olr"]))
        return at

    def scores(self, tokens: list[str], text: str) -> np.ndarray:
        ids = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if len(self.table) < len(self.roles):
            self.table = np.stack(self.roles)
        e = self.table[ids, 0] + self.crf.weights[_index(file_traits(tokens, text), "f", self.crf.settings.bits)].sum(0)
        e[1:] += self.table[ids[:-1], 1]
        e[:-1] += self.table[ids[1:], 2]
        return e

    def _viterbi(self, e: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[int]:
        best, back = before + e[0], []
        for x in e[1:]:
            ways = best[:, None] + self.crf.moves
            back.append(ways.argmax(0))
            best = ways.max(0) + x
        tag = int((best + after).argmax())
        path = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            path.append(tag)
        return path[::-1]

    def tags(self, tokens: list[str], text: str) -> list[tuple[int, list[int]]]:
        """Runs of tokens that may be tagged, and their tags on the best path; all others are outside."""
        e = self.scores(tokens, text)
        unsure = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.lead
        if not unsure.any():
            return []
        edges = np.flatnonzero(np.diff(np.concatenate([[False], unsure, [False]]).astype(np.int8)))
        m = self.crf.moves
        runs = []
        for a, b in zip(edges[::2], edges[1::2]):
            before = m[0] if a else self.crf.first
            after = m[:, 0] if b < len(tokens) else np.zeros(3)
            runs.append((int(a), self._viterbi(e[a:b], before, after)))
        return runs


def tagged_spans(text: str, tagger: Tagger, base: list[Span]) -> list[Span]:
    """Tagged spans that touch no base span, without quotes and punctuation around them."""
    tokens = text.split()
    if not tokens:
        return []
    runs = [r for r in tagger.tags(tokens, text) if any(r[1])]
    if not runs:
        return []
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    found: list[Span] = []
    for at, tags in runs:
        open_at = None
        for i, tag in enumerate([*tags, OUTSIDE]):
            if open_at is not None and tag != INSIDE:
                a, b = places[at + open_at][0], places[at + i - 1][1]
                while a < b and text[a] in "\"'`([{<,;.":
                    a += 1
                while a < b and text[b - 1] in "\"'`)]}>,;.!?:":
                    b -= 1
                if a < b and all(b <= x or y <= a for _, x, y in base):
                    found.append(("tagged", a, b))
                open_at = None
            if tag != OUTSIDE and open_at is None:
                open_at = i
    return found


def fit(docs: DataFrame, s: Settings = Settings()) -> Crf | None:
    """Learn from the windows of each kind with the smallest hashes, of all texts."""
    placed = docs.select(F.xxhash64("doc_id").alias("order"), "text")
    schema = "marked boolean, rank long, order long, centre long, tokens array<string>, tags array<long>, of_file array<string>"
    windows = kept(in_tasks(placed, lambda it: _windows(s, it), schema), "secret-windows")
    rows = []
    for marked in (True, False):
        some = windows.filter(F.col("marked") == marked).orderBy("rank", "order", "centre", "tokens").limit(s.windows)
        rows += [(list(r.tokens), list(r.tags), list(r.of_file)) for r in some.collect()]
    return learn(rows, s)


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def find_secrets(docs: DataFrame, crf: Crf | None, masked: bool = False) -> DataFrame:
    """``docs`` with ``spans`` by start, then kind; ``masked`` also replaces them in ``text``.

    Overlapping spans are masked as one; a text without spans stays as it is.
    """
    docs = docs.drop("spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", SPANS)])
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None if sent.value is None else Tagger(sent.value)
        for batch in batches:
            spans, texts = [], []
            for value in batch.column("text"):
                text = value.as_py()
                own = base_spans(text or "")
                if tagger is not None:
                    own = sorted(own + tagged_spans(text or "", tagger, own), key=lambda x: (x[1], KINDS.index(x[0])))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                texts.append(mask(text, own) if masked and own else text)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            columns = {n: batch.column(n) for n in names}
            if masked:
                columns["text"] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(spans, kind)], names=[*names, "spans"])

    return in_tasks(docs, run, schema)


def mask(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    last_end = -1
    for _, a, b in spans:
        if a < last_end:
            if b > last_end:
                at = last_end = b
            continue
        out += [text[at:a], mark]
        at = last_end = b
    return "".join(out) + text[at:]
