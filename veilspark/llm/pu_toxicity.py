"""Toxicity from confirmed toxic texts and unlabelled ones (non-negative PU learning).

A linear classifier over hashed words and word beginnings is fitted in numpy on the driver
by the class-prior-corrected risk ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` with the
sigmoid loss; only positive labels, the prior and unlabelled texts enter. The sample it is fitted on is bounded
by ``Settings.positives`` and ``Settings.unlabelled``; every text is scored, whole, in tasks.

Defined results: a null text counts as empty; an empty text scores by the intercept; without
confirmed toxic texts every score is 0. Rows with a null id are scored and never learnt from.
A doc_id that is labelled more than once is toxic if any of its labels is. Extra columns pass
through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import words as W
from veilspark.llm.storage import in_tasks


@dataclass(frozen=True)
class Settings:
    positives: int = 3000  # bound of confirmed toxic texts that are learnt from
    unlabelled: int = 9000  # bound of unlabelled texts that are learnt from
    bits: int = 18  # hashed features
    rare: int = 3  # features of fewer confirmed texts are left out
    lift: float = 4.0  # so many times as common in confirmed texts as in the others, at least
    sure: float = 4.0  # and so many standard errors apart
    beginnings: tuple[int, ...] = (4, 5, 6)  # bytes
    epochs: int = 40
    batch: int = 500
    rate: float = 0.05
    shrink: float = 1e-4  # pull of the weights to zero
    start: float = 0.5  # share of a feature's log ratio that it starts from
    seed: int = 11


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings


def features(w: W.Words, s: Settings, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, feature)`` of a slice and how often each occurs; weightless ones left out."""
    text = np.repeat(np.arange(len(w.first) - 1), w.counts)
    shift = np.uint64(64 - s.bits)
    found = []
    for which, h in [(slice(None), w.hash), *map(w.beginnings, s.beginnings)]:
        f = (h >> shift).astype(np.int64)
        t = text[which]
        if weights is not None:
            has = weights[f] != 0
            f, t = f[has], t[has]
        found.append((t << s.bits) | f)
    codes, times = np.unique(np.concatenate(found), return_counts=True)
    return codes >> s.bits, codes & ((1 << s.bits) - 1), times


def _sample_features(s: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, b, data, offsets in W.slices(batch.column("text")):
            text, feature, times = features(W.words_of(data, offsets), s)
            at = np.searchsorted(text, np.arange(b - a + 1))
            rows += [(feature[x:y].astype(np.int32), times[x:y].astype(np.int32)) for x, y in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("positive"),
                pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            ],
            names=["positive", "feature", "times"],
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _telling(
    texts: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, s: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Features that stand out in confirmed texts against unlabelled ones, and log ratios of all."""
    seen = np.zeros((2, 1 << s.bits))
    for (f, _), is_p in zip(texts, positive):
        seen[int(is_p), f] += 1
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    in_p, in_u = seen[1] / n_p, seen[0] / n_u
    both = (seen[0] + seen[1] + 1) / (n_p + n_u + 1)
    error = np.sqrt(both * (1 - np.minimum(both, 0.999)) * (1 / n_p + 1 / n_u))
    telling = (seen[1] >= s.rare) & (in_p >= s.lift * in_u) & (in_p - in_u >= s.sure * error)
    return telling, np.log((seen[1] + 0.5) / (n_p + 1)) - np.log((seen[0] + 0.5) / (n_u + 1))


def learn(texts: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, prior: float, s: Settings) -> Model:
    """Fit on sparse texts; ``positive`` marks the confirmed ones, all others are unlabelled."""
    n_features = 1 << s.bits
    usable, ratio = _telling(texts, positive, s)
    number = np.cumsum(usable) - 1
    kept = [(number[f[usable[f]]], np.log1p(t[usable[f]])) for f, t in texts]
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w, b = s.start * ratio[usable], np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rng = np.random.default_rng(s.seed)
    rounds = max(1, -(-len(u) // s.batch))
    share = max(1, -(-len(p) // rounds))
    step = 0
    for _ in range(s.epochs):
        pu = rng.permutation(u)
        pp = rng.permutation(np.resize(p, share * rounds))
        for r in range(rounds):
            some_p, some_u = pp[r * share : (r + 1) * share], pu[r * s.batch : (r + 1) * s.batch]
            if not len(some_u):
                continue
            some = np.concatenate([some_p, some_u])
            f = np.concatenate([kept[i][0] for i in some])
            x = np.concatenate([kept[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(kept[i][0]) for i in some])
            q = _sigmoid(np.bincount(row, w[f] * x, len(some)) + b)
            of_p = np.arange(len(some)) < len(some_p)
            rest = q[~of_p].mean() - prior * q[of_p].mean()
            slope = q * (1 - q) * np.where(of_p, prior / len(some_p), 1 / len(some_u))
            negative = np.where(of_p, -slope, slope)
            g = np.where(of_p, -slope, 0) + negative if rest >= 0 else -negative
            grad = np.append(np.bincount(f, g[row] * x, len(w)) + s.shrink * w, g.sum())
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            move = s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
    weights = np.zeros(n_features, dtype=np.float32)
    weights[usable] = w
    return Model(weights, float(b), s)


def fit(docs: DataFrame, confirmed: DataFrame, prior: float, may_learn: Column, s: Settings = Settings()) -> Model | None:
    """Learn from ``docs`` whose ``doc_id`` is in ``confirmed`` and from unlabelled rows of ``may_learn``.

    Both samples are the rows with the smallest hashes of their ids, up to the bounds.
    """
    order = F.xxhash64("doc_id")
    ids = [r[0] for r in confirmed.select("doc_id").distinct().orderBy(order, "doc_id").limit(s.positives).collect()]
    if not ids or not 0 < prior < 1:
        return None
    pool = docs.filter(F.col("doc_id").isNotNull() & may_learn)
    last = pool.select(order.alias("h")).orderBy("h").limit(s.unlabelled).agg(F.max("h")).first()[0]
    if last is None:
        return None
    is_p = F.col("doc_id").isin(ids)
    sample = pool.filter(is_p | (order <= last)).select(is_p.alias("positive"), "text")
    out = T.StructType(
        [
            T.StructField("positive", T.BooleanType()),
            T.StructField("feature", T.ArrayType(T.IntegerType())),
            T.StructField("times", T.ArrayType(T.IntegerType())),
        ]
    )
    rows = in_tasks(sample, lambda it: _sample_features(s, it), out).limit(s.positives + s.unlabelled).toArrow()
    positive = rows["positive"].to_numpy(zero_copy_only=False).astype(bool)
    if not positive.any() or positive.all():
        return None
    texts = []
    for batch in rows.to_batches():
        f, t = batch.column("feature"), batch.column("times")
        at = f.offsets.to_numpy()
        fv, tv = f.values.to_numpy(), t.values.to_numpy()
        texts += [(fv[a:b], tv[a:b]) for a, b in zip(at, at[1:])]
    return learn(texts, positive, prior, s)


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of each whole text being toxic."""
    out = np.zeros(len(column))
    for a, b, data, offsets in W.slices(column):
        text, feature, times = features(W.words_of(data, offsets), model.settings, model.weights)
        sums = np.bincount(text, model.weights[feature].astype(float) * np.log1p(times), b - a)
        out[a:b] = _sigmoid(sums + model.bias)
    return out


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p = score_texts(batch.column("text"), m)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return in_tasks(docs, run, schema)


def fold(modulus: int) -> Column:
    """Fold of a row: crc32 of its doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Score ``docs``, learning from labels and texts outside fold 1 of 3 only."""
    may_learn = fold(3) != 1
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn).select("doc_id", "toxic")
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    confirmed = known.filter("toxic = 1")
    return score(docs, fit(docs, confirmed, prior or 0.0, may_learn, s))
