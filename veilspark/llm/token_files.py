"""Token ids in Arrow files of equal-length sequences and masks, and reading them back.

The ids of all texts, in ascending order of their ids and each ended by ``end_id``, fill
sequences of ``length`` ids; a mask marks the ids of a sequence that are real. A file holds
record batches of ``sequences`` sequences as fixed-size lists, so sequence ``i`` of a file is
at a known place of batch ``i // sequences`` and can be used in a memory map without copying.
Ids are unsigned 16-bit if the vocabulary allows it, else 32-bit.

Rows are dealt out by ranges of the id; each task writes the files of its range under a name
of its own attempt and returns where each text begins. That table is written before use, so
only files of finished tasks count and a lost executor costs its tasks alone. A text never
crosses files: the last sequence of a file is filled up and masked.

Defined results: a null text counts as empty and has only the end id; rows are ordered by id
(null first), then a hash of the text; repeated rows are written each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm.storage import folder_uri, held_in_worker, in_tasks, kept

WORDS_KEPT = 1_000_000
RUNS_KEPT = 500_000
"""Bounds of the tables of encoded words and runs of letters in each Python worker."""
TEXTS_AT_ONCE = 256

# The steps before merging for which a word of PLAIN can be taken apart.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LETTERS = "".join(c for c in map(chr, [*range(0x80), *range(0xC0, 0x100)]) if c.isalpha())
PLAIN = re.compile(f"([{LETTERS}]+)([{re.escape(string.punctuation)}]*)")
PLAIN_PART = re.compile(PLAIN.pattern.replace("+", "*", 1))


@dataclass(frozen=True)
class Layout:
    length: int = 2048  # ids of a sequence
    sequences: int = 128  # of a record batch
    end_id: int = 2
    wide: bool = False  # 32-bit ids

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u4" if self.wide else "<u2")

    def schema(self) -> pa.Schema:
        ids = pa.uint32() if self.wide else pa.uint16()
        return pa.schema([("ids", pa.list_(ids, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])


def plain_letters(tokenizer: Tokenizer) -> dict[str, str]:
    """What the library's steps before merging make of each letter in ``LETTERS``.

    Nothing, if the file has other steps or an added token that could stand inside a ``PLAIN`` word.
    """
    spec = json.loads(tokenizer.to_str())
    inside = [t for t in spec["added_tokens"] if PLAIN_PART.fullmatch(t["content"])]
    if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or inside:
        return {}
    return {x: tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(x))[0][0] for x in LETTERS}


class Words(dict):
    """Ids of blank-separated words as bytes; what is not known yet is encoded when asked for.

    The tokenizer lower-cases, composes characters and cuts at white space, none of which
    reaches across an ASCII blank or line feed, so a text's ids are those of its words in a row.

    Most words are a run of letters with punctuation behind it, which the tokenizer cuts there. If
    all letters are ASCII or Latin-1, each is lower-cased and spelt in bytes by itself, so the
    library's merges are asked for the letters alone; they are remembered without case and
    punctuation. Any other word goes through the whole of the library's steps.
    """

    def __init__(self, content: str, kind: np.dtype):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind, self.code = kind, "I" if kind.itemsize == 4 else "H"
        letters = plain_letters(self.tokenizer)
        self.plain = PLAIN.fullmatch if letters else lambda word: None
        self.spelt = str.maketrans(letters)
        self.merge = self.tokenizer.model.tokenize
        self.runs: dict[str, bytes] = {}

    def _run(self, letters: str) -> bytes:
        """Ids of a run of letters, given as the merges see it."""
        got = self.runs.get(letters)
        if got is None:
            got = array(self.code, [t.id for t in self.merge(letters)]).tobytes()
            if len(letters) <= 64:
                if len(self.runs) >= RUNS_KEPT:
                    self.runs.clear()
                self.runs[letters] = got
        return got

    def _whole(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = self.plain(word)
        if plain is None:
            got = self._whole(word)
        else:
            letters, behind = plain.groups()
            got = self._run(letters.translate(self.spelt))
            if behind:
                got += self[behind]
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        ids = self.__getitem__
        return [b"".join(map(ids, t.replace("\n", " ").split(" "))) for t in texts]


def words_for(content: str, kind: np.dtype) -> Words:
    """The worker's table for a tokenizer file's contents, built once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of work
    return held_in_worker("words" + hashlib.sha256(content.encode()).hexdigest() + kind.str, lambda: Words(content, kind))


class SequenceFile:
    """Writes one file; ids are held back only until a record batch is full."""

    def __init__(self, uri: str, layout: Layout):
        self.uri, self.layout = uri, layout
        self.store, path = fs.FileSystem.from_uri(uri)
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = self.store.open_output_stream(path)
        self.writer = ipc.new_file(self.sink, layout.schema())
        self.waiting: list[bytes] = []
        self.waiting_ids = self.ids = 0

    def add(self, data: bytes) -> int:
        """Append a text's ids; the place of the first of them in the file."""
        at = self.ids
        n = len(data) // self.layout.kind.itemsize
        self.waiting.append(data)
        self.waiting_ids += n
        self.ids += n
        if self.waiting_ids >= self.layout.length * self.layout.sequences:
            self._write(False)
        return at

    def _write(self, last: bool) -> None:
        s = self.layout
        ids = np.frombuffer(b"".join(self.waiting), dtype=s.kind)
        batch = s.length * s.sequences
        full = len(ids) if last else len(ids) // batch * batch
        for a in range(0, full, batch):
            part = ids[a : min(a + batch, full)]
            rows = -(-len(part) // s.length)
            real = np.arange(rows * s.length) < len(part)
            part = np.concatenate([part, np.zeros(rows * s.length - len(part), dtype=s.kind)])
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), s.length) for x in (part, real)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=s.schema()))
        self.waiting = [ids[full:].tobytes()]
        self.waiting_ids = len(ids) - full

    def close(self) -> None:
        if self.waiting_ids:
            self._write(True)
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to the sequences of one file; a local file is mapped, not read."""

    def __init__(self, uri: str, layout: Layout):
        store, path = fs.FileSystem.from_uri(uri)
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.file, self.layout = ipc.open_file(self.source), layout
        self.at, self.batch = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.batch = i, self.file.get_batch(i)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        s = self.layout
        batch, row = self._batch(i // s.sequences), i % s.sequences
        ids = batch.column("ids").values.to_numpy()[row * s.length : (row + 1) * s.length]
        mask = batch.column("mask").values.slice(row * s.length, s.length).to_numpy(zero_copy_only=False)
        return ids, mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ``n`` ids from place ``start`` of the file on."""
        size = self.layout.length * self.layout.sequences
        parts = []
        while n > 0:
            values = self._batch(start // size).column("ids").values.to_numpy()
            part = values[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.layout.kind)


def write_tokens(docs: DataFrame, tokenizer: str, layout: Layout = Layout(), id_col: str = "doc_id") -> DataFrame:
    """Encode ``text`` and write the files; the written index ``(id, file, place, n_tokens, part, at)``.

    ``part`` and ``at`` number the files and the texts in a file in order. ``tokenizer`` is the
    path of the tokenizer's file on the driver.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    spark = docs.sparkSession
    folder, sent = folder_uri(spark, "tokens"), spark.sparkContext.broadcast(content)
    rows = docs.select(F.col(id_col).alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    order = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(sent.value, layout.kind)
        end = np.array([layout.end_id], dtype=layout.kind).tobytes()
        file, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                file = SequenceFile(f"{folder}/{batch.column('part')[0].as_py():06d}-{uuid.uuid4().hex}.arrow", layout)
            places, sizes = [], []
            for a in range(0, batch.num_rows, TEXTS_AT_ONCE):
                texts = batch.column("text").slice(a, TEXTS_AT_ONCE).to_pylist()
                for data in words.encode([t or "" for t in texts]):
                    places.append(file.add(data + end))
                    sizes.append(len(data) // layout.kind.itemsize + 1)
            n = batch.num_rows
            arrays = [batch.column("id"), pa.array([file.uri] * n), pa.array(places), pa.array(sizes), batch.column("part")]
            arrays.append(pa.array(np.arange(count, count + n)))
            count += n
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "file", "place", "n_tokens", "part", "at"])
        if file is not None:
            file.close()

    return kept(in_tasks(dealt, run, f"id {kind}, file string, place long, n_tokens long, part int, at long"), "token-index")


def read_tokens(index: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Per text ``id, start, n_tokens, ids_crc32``, all from the files that ``index`` names.

    ``start`` counts the ids of all texts before it. The files' totals are summed up over the
    parts, of which there are as many as tasks wrote.
    """
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.alias("before"))
    parts = max(1, index.select("part").distinct().count())
    dealt = index.repartition(parts, "part").sortWithinPartitions("part", "at")
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            crcs, sizes = [], []
            for uri, place, n in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist(), batch.column("n_tokens").to_pylist()):
                if reader is None or reader[0] != uri:
                    reader = uri, SequenceReader(uri, layout)
                ids = reader[1].ids(place, n)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            arrays = [batch.column("id"), batch.column("part"), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "part", "place", "n_tokens", "ids_crc32"])

    read = in_tasks(dealt, run, f"id {kind}, part int, place long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(starts), "part").select(
        "id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
