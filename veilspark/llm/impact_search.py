"""Exact top-k by integer inner product over an impact-ordered index.

Components become integers ``floor(scale * x)``. Rows are dealt into shards; in a shard every
dimension is a posting list, ordered by value and cut into segments of equal quantised value.
For a query, a posting's impact is its contribution above the smallest one of its dimension.
Segments are processed score at a time, by descending impact over all dimensions together; a
row's accumulator then bounds its score from above, since what is still unread of it lies
below the current impact. Rows that lead are scored exactly, so a threshold of true scores
grows. A query stops only when no bound of an unscored row reaches its threshold, and every
row whose bound does is scored exactly before that. Ties with the threshold are scored too.

Queries are a stated set that is compared with all rows: blocks of queries meet shards of
rows, both of bounded size. Each query keeps its best k of each shard, and the best k of those.

Defined results: vectors that are null, empty, or hold null or non-finite components, and
rows without an id, take no part. Queries and rows of different dimensions do not meet. Rows
with the query's own id are its own. Rows that repeat an id are separate candidates; of rows
with equal score and id any is as good as the other. Components must stay below 2**31 after
scaling, scores fit 64 bits. Without rows or queries the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.storage import kept, parts_for, ship_code


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    k: int = 5
    shard_rows: int = 16_384
    block_queries: int = 256
    level_bits: int = 2  # postings whose values agree but for these bits are one segment
    fall: float = 0.4  # of the impact from step to step
    outright: int = 6  # a shard's rows divided by this may be scored exactly to end a query


class ShardIndex:
    """Posting lists of one shard: per dimension the rows by value, and where segments begin."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, s: Settings):
        self.ids, self.x, self.s = ids, x, s
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.segments = []
        for v in self.values:
            level = v >> s.level_bits
            self.segments.append(np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(v)]]))

    def _cuts(self, q: np.ndarray, impact: int) -> np.ndarray:
        """Per dimension, how many postings from its strong end have segments of ``impact`` or more."""
        cuts = np.zeros(len(q), dtype=np.int64)
        for j, w in enumerate(q.tolist()):
            if w == 0:
                continue
            v, seg = self.values[j], self.segments[j]
            if w > 0:
                # The strongest posting of a segment is its last.
                strong = (v[seg[1:] - 1] - self.low[j]) * w
                at = int(np.searchsorted(strong, impact))
                cuts[j] = len(v) - seg[at]
            else:
                strong = (v[seg[:-1]] - self.high[j]) * w
                at = int(np.searchsorted(-strong, -impact, side="right"))
                cuts[j] = seg[at]
        return cuts

    def top(self, own_id: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows for a query, best first."""
        n, k = len(self.ids), self.s.k
        own = self.ids == own_id
        if own.all():
            return self.ids[:0], self.ids[:0]
        floor = int(np.where(q > 0, q * self.low, q * self.high).sum())
        reach = np.abs(q) * (self.high - self.low)
        used = q != 0
        # One number per row: what it has gained, and above that how many postings were read.
        one = 1 << max(1, int(reach.sum()).bit_length())
        total = np.zeros(n, dtype=np.int64 if one * (len(q) + 1) < 1 << 63 else object)
        exact = np.full(n, np.iinfo(np.int64).min)
        scored = own.copy()
        done = np.zeros(len(q), dtype=np.int64)
        impact = int(reach.max()) if len(reach) else 0
        while True:
            impact = int(impact * self.s.fall)
            cuts = self._cuts(q, impact)
            for j in np.flatnonzero(cuts > done).tolist():
                a, b = int(done[j]), int(cuts[j])
                w = int(q[j])
                if w > 0:
                    rows, v = self.order[j, n - b : n - a], (self.values[j, n - b : n - a] - self.low[j]) * w
                else:
                    rows, v = self.order[j, a:b], (self.values[j, a:b] - self.high[j]) * w
                total[rows] += v + one
                done[j] = b
            # A posting not read yet has an impact below ``impact``.
            bound = (total % one + (int(used.sum()) - total // one) * max(0, impact - 1) + floor).astype(np.int64)
            bound[scored] = np.iinfo(np.int64).min
            lead = np.argpartition(-bound, min(4 * k, n - 1))[: 4 * k] if n > 4 * k else np.arange(n)
            lead = lead[~scored[lead]]
            exact[lead] = self.x[lead] @ q
            scored[lead] = True
            known = np.flatnonzero(scored & ~own)
            if len(known) < k and len(known) < n - own.sum():
                if impact <= 0:
                    break
            else:
                threshold = np.partition(exact[known], max(0, len(known) - k))[max(0, len(known) - k)]
                bound[scored] = np.iinfo(np.int64).min
                open_rows = np.flatnonzero(bound >= threshold)
                # Stop on proof, or when it is cheaper to score the possible members than to read on.
                if len(open_rows) <= max(8 * k, n // self.s.outright) or impact <= 0:
                    exact[open_rows] = self.x[open_rows] @ q
                    scored[open_rows] = True
                    break
        known = np.flatnonzero(scored & ~own)
        best = known[np.lexsort((self.ids[known], -exact[known]))][:k]
        return self.ids[best], exact[best]


def integer_vectors(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, dim, x)`` of the rows that take part; ``x`` holds the scaled components."""
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * s.scale))
    good = F.col(id_col).isNotNull() & (F.size(vector_col) > 0)
    odd = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.filter(good & ~odd).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), x.alias("x"))


def _search(key: tuple, rows: pa.Table, queries: pa.Table, s: Settings) -> pa.Table:
    dim = key[-1].as_py()

    def matrix(t: pa.Table) -> np.ndarray:
        return t["x"].combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim) if len(t) else np.zeros((0, dim), np.int64)

    empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
    if not len(rows) or not len(queries):
        return pa.table(empty)
    index = ShardIndex(rows["id"].to_numpy(), matrix(rows), s)
    out = [(i, *index.top(i, q)) for i, q in zip(queries["id"].to_numpy(), matrix(queries))]
    return pa.table(
        {
            "query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64),
            "vec_id": np.concatenate([o[1] for o in out]).astype(np.int64),
            "score": np.concatenate([o[2] for o in out]).astype(np.int64),
        }
    )


def top_k(vectors: DataFrame, is_query: F.Column, s: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``s.k`` best rows for the rows where ``is_query`` holds.

    ``is_query`` may use ``id``. The vectors are written once with the number of their shard
    and, for queries, of their block; both are dealt out by row number, so repeated vectors
    and ids spread evenly.
    """
    ship_code(vectors.sparkSession)
    rows = kept(integer_vectors(vectors, s).withColumn("at", F.monotonically_increasing_id()), "vectors")
    queries = rows.filter(is_query)
    shards, blocks = parts_for(rows.count(), s.shard_rows), parts_for(queries.count(), s.block_queries)
    spread = F.xxhash64("at")
    left = rows.select("dim", "id", "x", F.pmod(spread, F.lit(shards)).cast("int").alias("shard"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("dim", "id", "x", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["shard", "block", "dim"]
    found = (
        left.groupBy(keys)
        .cogroup(right.groupBy(keys))
        .applyInArrow(lambda key, a, b: _search(key, a, b, s), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= s.k)
        .select("query_id", "rank", "vec_id", "score")
    )
