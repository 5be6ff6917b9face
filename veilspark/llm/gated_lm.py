"""Log-probabilities of whole texts by a gated recurrent language model over corpus counts.

Counts of every word of all training texts come first, as a written table. The most frequent
words and, for the others, groups by their first two bytes are the units of a recurrent model
with one gated layer and a class-factored softmax; a word outside the unit list has the
probability of its group times its share of the group by the counts, so every text has a
proper probability. The model starts from the counts (output biases) and is trained by
truncated backpropagation in numpy, inside tasks: every training text is read whole, in windows
whose states carry over (a text of more than ``stretch_words`` words in several stretches, each
with its own start state); each task trains on its own share of the stretches and the tasks'
weights are averaged, ``rounds`` times. What is gathered thus grows with the corpus, while the
model keeps its size.

Scoring reads every whole text in windows of ``window`` words with the state carried across,
so memory does not grow with a text. Words outside a bounded list of frequent ones are looked
up in the counts by a join.

Defined results: a null text counts as empty and has the end token only. A row with a null id
is in fold 0 of nothing: it is learnt from and not held out. Without training texts both
scores are 0 for every token. Repeated rows each count and each are scored. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.storage import in_tasks, kept

END = np.uint64(0)
PIECE_ROWS = 1024
"""Rows of the softmax that are worked off at once."""
STRETCH_ROWS = 1000
"""Stretches of a long text that are handed on at once."""
BUCKET_BITS = 17
"""Words are looked up under so many leading bits of their hashes."""
_LOWER = np.arange(256)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    smoothing: float = 0.1
    frequent: int = 100_000  # words whose counts are sent to every task
    counted_words: int = 200_000  # counts that a task holds before it sends them on
    units: int = 1024  # words and groups that the model tells apart
    groups: int = 32  # of them, groups of rarer words
    classes: int = 32  # of the softmax
    hidden: int = 16
    stretch_words: int = 1024  # of a training text that one start state is carried through; a longer text gives several
    window: int = 16  # words of a truncated backpropagation
    batch: int = 512  # texts trained together
    rounds: int = 2
    rate: float = 0.02
    score_tokens: int = 150_000  # tokens whose states are held at once
    read_tokens: int = 1_500_000  # of the texts that are read side by side; a longer text is read alone
    seed: int = 3


@dataclass(frozen=True)
class Lexicon:
    """Frequent words by hash with their counts and units, and totals of all."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray  # of the frequent words; -1 if the word is not a unit
    classes: np.ndarray  # of units
    places: np.ndarray  # of units in their class
    biases: tuple[np.ndarray, np.ndarray]  # log shares of the classes, and of units in a class
    group_tokens: np.ndarray
    group_words: np.ndarray
    tokens: int
    distinct: int
    settings: Settings = field(default_factory=Settings)

    @cached_property
    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes of each bucket begin, and all hashes with the highest number behind them."""
        leading = self.hashes >> np.uint64(64 - BUCKET_BITS)
        return np.searchsorted(leading, np.arange(1 << BUCKET_BITS, dtype=np.uint64)), np.append(self.hashes, np.uint64(2**64 - 1))

    @cached_property
    def lead_groups(self) -> np.ndarray:
        """The group of each pair of leading bytes."""
        return group_of(np.arange(1 << 16), self.settings.groups)

    def places_of(self, h: np.ndarray) -> np.ndarray:
        """As ``searchsorted(self.hashes, h)``, which is slow where both are many; buckets hold a few hashes."""
        begin, hashes = self.buckets
        at = begin[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        open_ = np.flatnonzero(hashes[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[hashes[at[open_]] < h[open_]]
        return at


def lead_bytes(w: W.Words, at: np.ndarray) -> np.ndarray:
    """The first two bytes of the words at some places as a number, letters A-Z lower-cased."""
    start = w.start[at]
    long = w.end[at] - start > 1
    return _LOWER[w.data[start]] * 256 + np.where(long, _LOWER[w.data[start + long]], 0)


def group_of(lead: np.ndarray, groups: int) -> np.ndarray:
    return (W.mix(lead.astype(np.uint64) + np.uint64(1)) % np.uint64(groups)).astype(np.int64)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts hashes, where each distinct one begins in it, and the distinct ones. Equal ones stand in any order."""
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    begin = np.flatnonzero(new)
    return order, begin, h[begin]


def _word_counts(s: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words, combined until ``s.counted_words`` rows are held."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = texts = 0

    def combined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, group, times = (np.concatenate([x[i] for x in held]) for i in range(3))
        order, begin, h = _distinct(h)
        return h, group[order[begin]], np.add.reduceat(times[order], begin) if len(h) else times

    def rows(h: np.ndarray, group: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(W.as_long(h)), pa.array(group.astype(np.int32)), pa.array(times)], names=["word", "grp", "c"])

    for batch in batches:
        texts += len(batch)
        for _, _, data, offsets in W.slices(batch.column("text")):
            w = W.words_of(data, offsets)
            order, begin, h = _distinct(w.hash)
            held.append((h, group_of(lead_bytes(w, order[begin]), s.groups), np.diff(begin, append=len(order))))
            size += len(h)
            if size > 2 * s.counted_words:
                held = [combined()]
                size = len(held[0][0])
                if size > s.counted_words:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*combined())
    if texts:
        yield rows(np.array([END]), np.array([-1]), np.array([texts], dtype=np.int64))


def lexicon(counts: DataFrame, s: Settings) -> Lexicon:
    """The bounded part of the counts: the most frequent words, and totals of the groups."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    end = int(W.as_long(np.array([END]))[0])
    words = counts.select("word", "c")
    top = words.filter(F.col("word") != end).orderBy(F.desc("c"), "word").limit(s.frequent - 1)
    top = top.unionByName(words.filter(F.col("word") == end)).toPandas().sort_values(["c", "word"], ascending=[False, True])
    is_unit = (top["word"] != end).cumsum().to_numpy() <= s.units - s.groups - 1
    is_unit |= top["word"].to_numpy() == end
    units = np.where(is_unit, np.cumsum(is_unit) - 1, -1)
    unit_rows = top[is_unit]
    n_words = len(unit_rows)
    rest = counts.filter(~F.col("word").isin(unit_rows["word"].tolist()))
    sums = {r.grp: (r.t, r.n) for r in rest.groupBy("grp").agg(F.sum("c").alias("t"), F.count("*").alias("n")).collect()}
    group_tokens = np.array([sums.get(g, (0, 0))[0] for g in range(s.groups)], dtype=float)
    group_words = np.array([sums.get(g, (0, 0))[1] for g in range(s.groups)], dtype=float)
    n_units = n_words + s.groups
    weight = np.concatenate([unit_rows["c"].to_numpy(float), group_tokens]) + s.smoothing
    # Classes of about equal numbers of units, the most frequent units together.
    by_weight = np.argsort(-weight, kind="stable")
    size = -(-n_units // s.classes)
    classes, places = np.zeros(n_units, dtype=np.int64), np.zeros(n_units, dtype=np.int64)
    classes[by_weight], places[by_weight] = np.arange(n_units) // size, np.arange(n_units) % size
    in_class = np.bincount(classes, weight, s.classes)
    inner = np.full((s.classes, size), -1e9)
    inner[classes, places] = np.log(weight)
    outer = np.where(in_class > 0, np.log(np.maximum(in_class, 1e-300)), -1e9)
    order = np.argsort(top["word"].to_numpy().astype(np.int64).view(np.uint64), kind="stable")
    return Lexicon(
        top["word"].to_numpy().astype(np.int64).view(np.uint64)[order],
        top["c"].to_numpy().astype(np.int64)[order],
        units[order],
        classes,
        places,
        (outer, inner),
        group_tokens,
        group_words,
        tokens,
        distinct,
        s,
    )


def find(lex: Lexicon, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: place among the frequent words (-1 if rarer), unit, and group (-1 if a unit)."""
    at = lex.places_of(w.hash)
    known = np.append(lex.hashes, END)[at] == w.hash
    known &= at < len(lex.hashes)
    unit = np.append(lex.units, -1)[np.where(known, at, len(lex.units))]
    rare = np.flatnonzero(unit < 0)
    group = np.full(len(unit), -1)
    group[rare] = lex.lead_groups[lead_bytes(w, rare)]
    unit[rare] = len(lex.classes) - lex.settings.groups + group[rare]
    return np.where(known, at, -1), unit, group


def _powers_of(scores: np.ndarray) -> np.ndarray:
    """``exp`` in place. Scores start at 0 or below, so that only a run-away model needs the bound."""
    return np.exp(np.minimum(scores, 60, out=scores), out=scores)


def _with_one(x: np.ndarray) -> np.ndarray:
    """``x`` and a column of ones, so that products add biases and sum their gradients on the way."""
    out = np.ones((len(x), x.shape[1] + 1), dtype=x.dtype)
    out[:, :-1] = x
    return out


class GatedModel:
    """A gated recurrent layer and a class-factored softmax; parameters in one vector."""

    def __init__(self, lex: Lexicon, vector: np.ndarray | None = None):
        s = self.s = lex.settings
        self.lex = lex
        n, h, c, m = len(lex.classes), s.hidden, s.classes, lex.biases[1].shape[1]
        self.shapes = {"wx": (n, 3 * h), "wh": (h, 3 * h), "b": (3 * h,), "wc": (h, c), "bc": (c,), "wi": (c, h, m), "bi": (c, m)}
        self.size = sum(math.prod(v) for v in self.shapes.values())
        if vector is None:
            rng = np.random.default_rng(s.seed)
            vector = rng.normal(0, 0.1, self.size).astype(np.float32)
        self.vector = vector
        self.p = self._parts(vector)

    def _parts(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters in a vector, or their gradients, by name."""
        ends = np.cumsum([math.prod(v) for v in self.shapes.values()]).tolist()
        return {name: vector[b - math.prod(v) : b].reshape(v) for (name, v), b in zip(self.shapes.items(), ends)}

    @classmethod
    def started(cls, lex: Lexicon) -> GatedModel:
        model = cls(lex)
        model.p["b"][:] = 0
        for name, start in zip(("bc", "bi"), lex.biases):
            highest = start.max(axis=-1, keepdims=True)
            # Empty classes and places have a share that is nothing beside any other.
            model.p[name][:] = np.maximum(start - np.where(highest > -1e8, highest, 0), -60)
        model.p["wc"] *= 0.1
        model.p["wi"] *= 0.1
        return model

    def by_gate(self) -> tuple[np.ndarray, np.ndarray]:
        """Input weights with their biases ``(3 * units, hidden)`` and state weights ``(3, hidden, hidden)``, a gate after the other.

        Arithmetic on whole arrays of a gate is many times faster than on parts of short rows.
        """
        k = self.s.hidden
        wx, wh = (np.ascontiguousarray(x.reshape(-1, 3, k).swapaxes(0, 1)) for x in (self.p["wx"] + self.p["b"], self.p["wh"]))
        return wx.reshape(-1, k), wh

    def inputs(self, wx: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Input gates ``(3, units, hidden)`` of units that are read."""
        return np.take(wx, unit + len(self.lex.classes) * np.arange(3)[:, None], axis=0)

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step for a batch: new state, and what backpropagation needs. ``x`` are input gates."""
        g = h @ wh
        gates = g[:2]
        gates += x[:2]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        z, r = np.reciprocal(gates, out=gates)
        cand = r * g[2]
        cand += x[2]
        np.tanh(cand, out=cand)
        new = cand - h
        new *= z
        new += h
        return new, z, r, cand, g[2]

    def softmax_weights(self) -> np.ndarray:
        """Of each class, weights of the classes and of its units side by side, biases as the last row."""
        p, k, c = self.p, self.s.hidden, self.s.classes
        w = np.empty((c, k + 1, c + p["bi"].shape[1]), dtype=self.vector.dtype)
        w[:, :k, :c], w[:, k, :c], w[:, :k, c:], w[:, k, c:] = p["wc"], p["bc"], p["wi"], p["bi"]
        return w

    def log_probabilities(self, states: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural log of each unit's probability after its state."""
        order, edges, place = self._by_class(unit)
        own, weights, halves = _with_one(states[order]), self.softmax_weights(), self._halves()
        line = len(halves) * np.arange(min(len(unit), PIECE_ROWS)) + self.s.classes
        logs = np.empty(len(unit), dtype=own.dtype)
        for c, a, b in self._pieces(edges):
            share = _powers_of(own[a:b] @ weights[c])
            whole = np.log(share @ halves)
            logs[a:b] = np.log(share[:, c]) + np.log(share.reshape(-1)[line[: b - a] + place[a:b]]) - whole[:, 0] - whole[:, 1]
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def _by_class(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the units by class, where classes begin in it, and places in that order."""
        cls = self.lex.classes[unit].astype(np.int16)
        order = np.argsort(cls, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=self.s.classes))])
        return order, edges, self.lex.places[unit[order]]

    def _pieces(self, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Class, begin and end of runs of rows of one class, short enough to stay in a processor's cache."""
        for c, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            for at in range(a, b, PIECE_ROWS):
                yield c, at, min(b, at + PIECE_ROWS)

    def _halves(self) -> np.ndarray:
        """Which of the columns of ``softmax_weights`` are classes, and which units."""
        is_class = np.arange(self.s.classes + self.lex.biases[1].shape[1]) < self.s.classes
        return np.stack([is_class, ~is_class], 1).astype(self.vector.dtype)

    def train_window(self, given: np.ndarray, want: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of a window ``(time, texts)``, the last state, and the loss; the state is not differentiated beyond.

        A text is live until it ends.
        """
        k, classes, kind = self.s.hidden, self.s.classes, self.vector.dtype
        # The longest first: the live texts of a step are its first, and live cells stand one after another.
        longest = np.argsort(-live.sum(0), kind="stable")
        given, want, live = (x[:, longest] for x in (given, want, live))
        edge = np.concatenate([[0], np.cumsum(live.sum(1))]).tolist()
        cells = edge[-1]
        n = max(1, cells)
        given, want = given[live], want[live]
        wx, wh = self.by_gate()
        x = self.inputs(wx, given)
        before, after = (np.empty((cells, k), dtype=kind) for _ in range(2))
        steps = []
        last = h[longest].astype(kind)
        for a, b in zip(edge, edge[1:]):
            before[a:b] = last[: b - a]
            new, *kept_for_later = self.step(x[:, a:b], before[a:b], wh)
            after[a:b] = last[: b - a] = new
            steps.append(kept_for_later)
        order, edges, place = self._by_class(want)
        own, weights, halves = _with_one(after[order]), self.softmax_weights(), self._halves()
        grads = np.zeros_like(weights)
        ds = np.empty((cells, k), dtype=kind)
        whole, share_of = np.empty((cells, 2), dtype=kind), np.empty((2, cells), dtype=kind)
        line = len(halves) * np.arange(min(cells, PIECE_ROWS)) + classes
        part, back = kind.type(1 / n), np.ascontiguousarray(weights[:, :k].swapaxes(1, 2))
        for c, a, b in self._pieces(edges):
            # Derivative of the mean loss by the scores of the classes and of the class's units.
            share = _powers_of(own[a:b] @ weights[c])
            own_class, flat, chosen = share[:, c], share.reshape(-1), line[: b - a] + place[a:b]
            share_of[0, a:b], share_of[1, a:b] = own_class, flat[chosen]
            np.matmul(share, halves, out=whole[a:b])
            share *= (part / whole[a:b]) @ halves.T
            own_class -= part
            flat[chosen] -= part
            grads[c] += own[a:b].T @ share
            np.matmul(share, back[c], out=ds[a:b])
        loss = float(np.log(whole).sum() - np.log(share_of).sum())
        dafter = np.empty((cells, k), dtype=kind)
        dafter[order] = ds
        # By what the state adds to the three gates, and by the last input gate; by the other input gates it is the same.
        dx = np.empty((4, cells, k), dtype=kind)
        dwh = np.zeros_like(wh)
        back = np.ascontiguousarray(wh.swapaxes(1, 2))
        dh = np.zeros((0, k), dtype=kind)
        for t in range(len(steps) - 1, -1, -1):
            a, b = edge[t], edge[t + 1]
            z, r, cand, g = steps[t]
            d = dafter[a:b]
            d[: len(dh)] += dh
            dz = d * z
            dgate, dreset, dg, dcand = dx[:, a:b]
            np.multiply(cand, cand, out=dcand)
            np.subtract(1, dcand, out=dcand)
            dcand *= dz
            np.multiply(dcand, r, out=dg)
            np.subtract(1, r, out=dreset)
            dreset *= g
            dreset *= dg
            np.subtract(cand, before[a:b], out=dgate)
            dgate *= dz
            d -= dz
            dgate *= np.subtract(1, z, out=dz)
            dwh += before[a:b].T @ dx[:3, a:b]
            dh = d
            for by_state in dx[:3, a:b] @ back:
                dh += by_state
        grad = np.zeros_like(self.vector)
        p = self._parts(grad)
        total = grads.sum(0)
        p["wc"][:], p["bc"][:], p["wi"][:], p["bi"][:] = total[:k, :classes], total[k, :classes], grads[:, :k, classes:], grads[:, k, classes:]
        at = (given[:, None] * k + np.arange(k)).reshape(-1)
        for i, by_input in enumerate((dx[0], dx[1], dx[3])):
            by_unit = np.zeros(len(self.lex.classes) * k, dtype=kind)
            np.add.at(by_unit, at, by_input.reshape(-1))
            p["wx"][:, i * k : (i + 1) * k] = by_unit.reshape(-1, k)
        p["wh"][:], p["b"][:] = dwh.swapaxes(0, 1).reshape(k, -1), p["wx"].sum(0)
        state = np.empty_like(last)
        state[longest] = last
        return grad, state, loss


class Trainer:
    """Adam over stretches of units; the first unit of a stretch is the one before it."""

    def __init__(self, model: GatedModel, rate: float):
        self.model, self.rate = model, rate
        self.m, self.v, self.work = (np.zeros_like(model.vector) for _ in range(3))
        self.step = self.tokens = 0

    def read(self, stretches: list[np.ndarray]) -> None:
        s = self.model.s
        # Stretches of about equal length together, the longest first, in any order of batches.
        by_length = sorted(stretches, key=len, reverse=True)
        starts = np.arange(0, len(by_length), s.batch)
        for a in np.random.default_rng(s.seed).permutation(starts):
            some = by_length[a : a + s.batch]
            steps = np.array([len(x) - 1 for x in some])
            width = int(steps[0])
            units = np.zeros((width + 1, len(some)), dtype=np.int64)
            live = np.zeros((width + 1, len(some)), dtype=bool)
            for i, x in enumerate(some):
                units[: len(x), i], live[: len(x), i] = x, True
            h = np.zeros((len(some), s.hidden), dtype=np.float32)
            for t in range(0, width, s.window):
                to, n = min(width, t + s.window), int((steps > t).sum())
                alive = live[t + 1 : to + 1, :n]
                grad, h, _ = self.model.train_window(units[t:to, :n], units[t + 1 : to + 1, :n], alive, h[:n])
                self.tokens += int(alive.sum())
                self._move(grad)

    def _move(self, grad: np.ndarray) -> None:
        self.step += 1
        work = np.multiply(grad, grad, out=self.work)
        grad *= min(1.0, 1.0 / (float(np.sqrt(work.sum())) + 1e-9))
        np.subtract(grad, self.m, out=work)
        work *= 0.1
        self.m += work
        np.multiply(grad, grad, out=work)
        work -= self.v
        work *= 0.01
        self.v += work
        rate = self.rate / (1 + self.step / 200)
        np.sqrt(np.multiply(self.v, 1 / (1 - 0.99**self.step), out=work), out=work)
        work += 1e-6
        np.divide(self.m, work, out=work)
        work *= rate / (1 - 0.9**self.step)
        self.model.vector -= work


def score_units(model: GatedModel, unit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Summed natural log-probabilities of texts of units; each text's last unit is its end.

    Texts are read side by side in windows of time; only a window's states are held.
    """
    s, end = model.s, int(model.lex.units[np.searchsorted(model.lex.hashes, END)])
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(lengths))
    size, begin = lengths[order], first[order]
    h = np.zeros((len(order), s.hidden), dtype=np.float32)
    wx, wh = model.by_gate()
    t = 0
    while len(size) and t < size[0]:
        alive = int((size > t).sum())
        to = int(min(size[0], t + max(1, s.score_tokens // alive)))
        # The texts that live at each time are the first ones; their tokens stand one after another.
        live = np.searchsorted(-size, -np.arange(t, to), side="left")
        edge = np.concatenate([[0], np.cumsum(live)])
        text = np.arange(edge[-1]) - np.repeat(edge[:-1], live)
        at = begin[text] + np.repeat(np.arange(t, to), live)
        before = unit[at - 1]
        if t == 0:
            before[: live[0]] = end
        states = np.empty((len(at), s.hidden), dtype=np.float32)
        limits = edge.tolist()
        x = model.inputs(wx, before)
        for a, b in zip(limits, limits[1:]):
            h = states[a:b] = model.step(x[:, a:b], h[: b - a], wh)[0]
        out += np.bincount(order[text], model.log_probabilities(states, unit[at]), len(out))
        t = to
    return out


def _stretches(lex: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word and end of every text, once, in stretches that begin with the unit before them."""
    s = lex.settings
    end = int(lex.units[np.searchsorted(lex.hashes, END)])
    for batch in batches:
        place = batch.column("place").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in W.slices(batch.column("text")):
            lists, places, numbers = [], [], []
            w = W.words_of(data, offsets)
            unit = find(lex, w)[1] if len(w.hash) else np.zeros(0, np.int64)
            for i in range(b - a):
                own = np.concatenate([[end], unit[w.first[i] : w.first[i + 1]], [end]]).astype(np.int32)
                for number, at in enumerate(range(0, len(own) - 1, s.stretch_words)):
                    lists.append(own[at : at + s.stretch_words + 1])
                    places.append(place[a + i])
                    numbers.append(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.list_(pa.int32())), pa.array(places, pa.int64()), pa.array(numbers, pa.int32())],
                names=["units", "place", "number"],
            )


def _unit_type(lex: Lexicon) -> type:
    return np.int16 if len(lex.classes) <= 1 << 15 else np.int32


def _as_bytes(lex: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of a stretch as bytes, which Spark moves as one value and not one by one."""
    kind = _unit_type(lex)
    for whole in batches:
        for i in range(0, len(whole), STRETCH_ROWS):
            batch = whole.slice(i, STRETCH_ROWS)
            column = batch.column("units")
            at = column.offsets.to_numpy()
            values = column.values.to_numpy()[at[0] : at[-1]].astype(kind)
            edges = ((at - at[0]) * values.itemsize).astype(np.int32)
            units = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(edges), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([units, batch.column("place"), batch.column("number")], names=["units", "place", "number"])


def _from_bytes(lex: Lexicon, column: pa.BinaryArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _unit_type(lex)) for x in column]


def fit(docs: DataFrame, lex: Lexicon) -> np.ndarray:
    """Train on the whole of every text of ``docs``; the weights."""
    s, context = lex.settings, docs.sparkSession.sparkContext
    sent = context.broadcast(lex)
    placed = docs.select("text", F.xxhash64("doc_id", "text").alias("place"))
    stretches = in_tasks(placed, lambda it: _as_bytes(sent.value, _stretches(sent.value, it)), "units binary, place long, number int")
    # The stretches of a long text go to many tasks.
    keys = ["place", "number"]
    stretches = kept(stretches.repartition(*keys).sortWithinPartitions(*keys).select("units"), "lm-stretches")
    vector = GatedModel.started(lex).vector
    for number in range(s.rounds):
        weights = context.broadcast(vector)
        rate = s.rate / (1 + number)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(GatedModel(sent.value, weights.value.copy()), rate)
            for batch in batches:
                trainer.read(_from_bytes(sent.value, batch.column("units")))
            if trainer.tokens:
                share = trainer.model.vector.astype(np.float64) * trainer.tokens
                yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens]), pa.array([share], pa.list_(pa.float64()))], names=["tokens", "weights"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = 0.0, 0
            for batch in batches:
                for n, w in zip(batch.column("tokens").to_pylist(), batch.column("weights")):
                    total, tokens = total + w.values.to_numpy(), tokens + n
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([total], pa.list_(pa.float64()))], names=["tokens", "weights"])

        schema = "tokens long, weights array<double>"
        done = in_tasks(stretches, run, schema)
        # Sums of some tasks each, so that the driver gets few vectors.
        parts = max(1, round(len(stretches.inputFiles()) ** 0.5))
        sums = in_tasks(done.repartition(parts), add_up, schema).collect()
        if not sums:
            break
        vector = (sum(np.asarray(r.weights) for r in sums) / sum(r.tokens for r in sums)).astype(np.float32)
    return vector


def _scores(lex: Lexicon, vector: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = lex.settings
    model = GatedModel(lex, vector)
    end_at = int(np.searchsorted(lex.hashes, END))
    spread = np.log10(lex.group_tokens + s.smoothing * (lex.group_words + 1))
    logs = np.log10(lex.counts + s.smoothing)

    def read(waiting: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        lengths = np.concatenate([n for _, n in waiting])
        first = np.concatenate([[0], np.cumsum(lengths)])
        return score_units(model, np.concatenate([u for u, _ in waiting]), first) / np.log(10)

    for batch in batches:
        columns, waiting, held, by_model = [], [], 0, []
        for a, b, data, offsets in W.slices(batch.column("text")):
            w = W.words_of(data, offsets)
            n = b - a
            text = np.repeat(np.arange(n), w.counts)
            place, unit, group = find(lex, w) if len(w.hash) else (text, text, text)
            first = w.first + np.arange(n + 1)
            with_ends = np.empty(first[-1], dtype=np.int64)
            with_ends[first[1:] - 1] = lex.units[end_at]
            with_ends[np.arange(len(text)) + text] = unit
            if waiting and held + len(with_ends) > s.read_tokens:
                by_model.append(read(waiting))
                waiting, held = [], 0
            waiting.append((with_ends, w.counts + 1))
            held += len(with_ends)
            known, outside = place >= 0, group >= 0
            base = np.bincount(text[known], logs[place[known]], n) + logs[end_at]
            in_group = -np.bincount(text[outside], spread[group[outside]], n)
            listed = outside & known
            in_group += np.bincount(text[listed], logs[place[listed]], n)
            t, h = text[~known], w.hash[~known]
            order = np.argsort(h)
            order = order[np.argsort(t[order].astype(np.int16 if n < 1 << 15 else np.int64), kind="stable")]
            t, h = t[order], h[order]
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(t))).astype(np.int32)
            edges = np.searchsorted(t[at], np.arange(n + 1))
            columns.append((w.counts + 1, np.bincount(text[known], minlength=n) + 1, base, in_group, W.as_long(h[at]), times, np.diff(edges)))
        if not columns:
            continue
        by_model.append(read(waiting))
        whole = [np.concatenate([c[i] for c in columns]) for i in range(7)]
        whole[3] = whole[3] + np.concatenate(by_model)
        offsets = pa.array(np.concatenate([[0], np.cumsum(whole[6])]), pa.int32())
        arrays = [pa.array(x) for x in whole[:4]] + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in whole[4:6]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *arrays], names=["doc_id", "n_tokens", "n_known", "base", "model", "rare", "times"]
        )


def score_texts(docs: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of all ``docs``.

    The model learns from the rows where ``held_out`` is not true.
    """
    docs = docs.select("doc_id", "text")
    learnt = docs.filter(~F.coalesce(held_out, F.lit(False)))
    raw = in_tasks(learnt.select("text"), lambda it: _word_counts(s, it), "word long, grp int, c long")
    counts = kept(raw.groupBy("word").agg(F.max("grp").alias("grp"), F.sum("c").alias("c")), "lm-counts")
    is_out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base double, model double, rare array<long>, times array<int>"
    lex = lexicon(counts, s)
    if not lex.tokens:
        words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), ""))
        zero = F.lit(0.0)
        return docs.select(
            "doc_id", is_out, (words + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
            F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"),
        )
    vector = fit(learnt, lex)
    context = docs.sparkSession.sparkContext
    sent, weights = context.broadcast(lex), context.broadcast(vector)
    scored = in_tasks(docs, lambda it: _scores(sent.value, weights.value, it), schema)
    scored = kept(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    c = F.coalesce("c", F.lit(0))
    looked_up = (
        rare.join(counts.select(F.col("word").alias("rare"), "c"), "rare", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(c + F.lit(s.smoothing)) * F.col("times")).alias("rare_log"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    log_rare = F.coalesce("rare_log", F.lit(0.0))
    whole = float(np.log10(lex.tokens + s.smoothing * (lex.distinct + 1)))
    return scored.join(looked_up, "row", "left").select(
        "doc_id",
        is_out,
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log_rare - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + log_rare).alias("score"),
    )
