"""Vectors as short codes: parts replaced by the nearest entry of a codebook, found by bitmasks.

Components become integers ``floor(scale * x)`` and vectors are cut into equal consecutive
parts. Every part position has a codebook; rounds assign all parts to their nearest entry and
move the entries to the floored mean of their parts. The nearest entry is found by slicing
and intersecting: each dimension of a codebook is sorted, and each place in that order carries a
64-bit mask of the entries before it. The distance to one entry, guessed by the widest dimension,
is the first radius: the nearest entry, and any that ties with it, lies within that radius in
every dimension. So a range of places per dimension, as the difference of two prefix masks, and
the AND of these masks over all dimensions leave exactly the entries that can be nearest; those
alone are compared in full, ties going to the lower index.

Rows are read in tasks, once per round. A task sends one row of sums per entry and dimension,
so what is shuffled and collected is bounded by the size of the codebooks, not by the rows.

Defined results: vectors that are null, empty, hold null or non-finite components or components
of ``limit`` and beyond after scaling take no part (sums of such squares could pass 64 bits).
All vectors must have one length that the parts divide: that of the smallest id which has such
a length counts, vectors of other lengths take no part. Rows without an id come after all ids, rows that
repeat an id are ordered by their components. With fewer rows than entries there are as
many entries as rows. Without rows codebooks and result are empty. ``label_error`` is null where
it passes 64 bits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import in_tasks, kept, small_side


@dataclass(frozen=True)
class Settings:
    scale: int = 4096
    parts: int = 8
    entries: int = 16  # 64 at most, one bit each
    rounds: int = 6
    limit: int = 1 << 27


class Codebook:
    """The entries of one part position, sorted by every dimension, with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0).T.copy()
        bits = np.uint64(1) << self.order.T.astype(np.uint64)
        self.before = np.concatenate([np.zeros((width, 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        self.widest = int(np.argmax(self.sorted[:, -1] - self.sorted[:, 0]))

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks of the entries that can be nearest to each row of ``x``."""
        j, n = self.widest, len(self.entries)
        guess = self.order[np.minimum(np.searchsorted(self.sorted[j], x[:, j]), n - 1), j]
        squares = ((x - self.entries[guess]) ** 2).sum(axis=1)
        radius = np.sqrt(squares.astype(np.float64)).astype(np.int64) + 1  # never below the root
        mask = np.full(len(x), np.uint64(2**64 - 1))
        for j, (values, before) in enumerate(zip(self.sorted, self.before)):
            low = np.searchsorted(values, x[:, j] - radius)
            high = np.searchsorted(values, x[:, j] + radius, side="right")
            mask &= before[high] & ~before[low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, for each row of ``x``."""
        mask = self.candidates(x)
        row, entry = np.nonzero((mask[:, None] >> np.arange(len(self.entries), dtype=np.uint64)) & np.uint64(1))
        squares = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(squares, first)
        equal = np.flatnonzero(squares == least[row])
        equal = equal[np.concatenate([[True], row[equal][1:] != row[equal][:-1]])]
        return entry[equal], least


def integer_rows(
    vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(id, label, x)`` of the rows that take part. A written table."""
    odd = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) * s.scale >= s.limit))
    good = (F.size(vector_col) > 0) & (F.size(vector_col) % s.parts == 0) & ~odd
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * s.scale).cast("int"))
    rows = kept(vectors.filter(good).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")), "vectors")
    first = rows.orderBy(F.asc_nulls_last("id"), "x").select(F.size("x")).head()
    return rows.filter(F.size("x") == (first[0] if first else s.parts))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if len(batch):
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.astype(np.int64).reshape(len(batch), -1)


def first_books(rows: DataFrame, s: Settings = Settings()) -> np.ndarray | None:
    """The parts of the rows with the smallest ids: ``[part, entry, position]``."""
    heads = rows.orderBy(F.asc_nulls_last("id"), "x").limit(s.entries).select("x").collect()
    if not heads:
        return None
    return np.array([r.x for r in heads], dtype=np.int64).reshape(len(heads), s.parts, -1).transpose(1, 0, 2)


def moved_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows; entries without parts stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)  # the last place counts
        finders = [Codebook(b) for b in books]
        for _, x in _matrices(batches):
            for p, finder in enumerate(finders):
                part = x[:, p * width : (p + 1) * width]
                entry, _ = finder.nearest(part)
                np.add.at(total[p], entry, np.concatenate([part, np.ones((len(part), 1), np.int64)], axis=1))
        slot = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_pydict({"slot": slot.astype(np.int32), "total": total.ravel()[slot]})

    found = in_tasks(rows.select("x"), sums, "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    total = np.zeros(parts * entries * (width + 1), dtype=np.int64)
    for r in found.collect():  # one row per codebook component at most
        total[r.slot] = r.total
    total = total.reshape(parts, entries, width + 1)
    count = total[..., -1:]
    return np.where(count > 0, total[..., :-1] // np.maximum(count, 1), books)


def fit_books(rows: DataFrame, s: Settings = Settings()) -> np.ndarray | None:
    """Codebooks ``[part, entry, position]`` after ``s.rounds`` rounds; None without rows."""
    books = first_books(rows, s)
    for _ in range(s.rounds if books is not None else 0):
        books = moved_books(rows, books)
    return books


def encode_rows(rows: DataFrame, books: np.ndarray | None) -> DataFrame:
    """``(id, label, code, error)``: a byte per part, and the squared distances summed over parts."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code binary, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)
    parts, _, width = books.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Codebook(b) for b in books]
        for batch, x in _matrices(batches):
            found = [f.nearest(x[:, p * width : (p + 1) * width]) for p, f in enumerate(finders)]
            code = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            body = pa.py_buffer(code.tobytes())
            places = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * parts)
            code = pa.Array.from_buffers(pa.binary(), len(x), [None, places, body])
            error = pa.array(sum(d for _, d in found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), code, error], ["id", "label", "code", "error"])

    return in_tasks(rows, codes, schema)


def compress(
    vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray | None]:
    """``(id, label, code, error, label_error)`` of the rows that take part, and the codebooks.

    ``label_error`` is the error summed over equal labels, nulls together.
    """
    rows = integer_rows(vectors, s, id_col, vector_col, label_col)
    books = fit_books(rows, s)
    coded = kept(encode_rows(rows, books), "codes")
    sums = kept(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    result = coded.join(small_side(sums, 64), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return result, books
