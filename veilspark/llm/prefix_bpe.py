"""Byte-level BPE by dynamic programming over prefixes, and decoding.

Every prefix of a pretoken has exactly one encoding, so it is enough to store its last token.
An automaton over the vocabulary's byte strings yields the tokens that end at each position;
a token is the last one of a prefix if what is before it ends in a token with which it is a
compatible pair, that is, if the two tokens' bytes encode to just these two. Following the
stored tokens back from the end gives the ids. The work is linear in the text, whatever the
order of merges.

Encoding and decoding run in tasks; the vocabulary file is read on the driver and sent to the
executors, its size is that of the vocabulary. Words seen before come from a bounded table.

Defined results: a null text counts as empty and has no ids. Strings of added tokens in a text
become their ids. Decoding joins the tokens' bytes and replaces what is not UTF-8. Extra
columns pass through; columns named like results are replaced; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspark.llm.storage import held_in_worker, in_tasks

# Fixed value: how texts are cut before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_SPACES = re.compile(r" \s|\s ")
SIMPLE = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
"""Parts that are surely one pretoken."""
WORDS_KEPT = 500_000
PAIRS_KEPT = 1_000_000
"""Bounds of the tables of encoded words and tested pairs in each Python worker."""


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder for the contents of a byte-level BPE file (``tokenizers`` JSON)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        byte_of = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for at, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ids, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(ids, at)
            self.merged.setdefault(ids, whole)
            if whole not in self.halves:
                self.halves[whole], self.made_at[whole] = ids, at
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in self.halves or len(t) == 1:
                b = self.bytes_of[i]
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}  # ids as unsigned 32-bit integers in a row: one small object for each word
        self.written = {i: str(i) for i in self.bytes_of}
        self.cut = regex.compile(PRETOKEN)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens encode to exactly ``left, right``.

        Undo the merges that built the two tokens, latest first. A merge across the seam that
        would have come before the one undone, or at all at first, would have been taken.
        """
        made, rank, halves = self.made_at, self.rank, self.halves
        # Until this merge is reached, the two halves at the seam stand as they are.
        until = len(rank) + 1
        while True:
            across = rank.get((left, right))
            if across is not None and across < until:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                until, left = a, halves[left][1]
            else:  # of equal merges the leftmost comes first, a seam merge before the right one
                until, right = b + 1, halves[right][0]

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pretoken."""
        if not data:
            return ()
        last, length = [-1] * len(data), [0] * len(data)
        pairs, check = self.pairs, self._compatible
        done = -1
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            if end == done:
                continue
            before = end - size
            if before >= 0:
                left = last[before]
                key = left << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    fits = pairs[key] = check(left, token)
                if not fits:
                    continue
            last[end], length[end] = token, size
            done = end
        ids = []
        end = len(data) - 1
        while end >= 0:
            ids.append(last[end])
            end -= length[end]
        return tuple(reversed(ids))

    def _piece(self, text: str) -> bytes:
        got = self.known.get(text)
        if got is None:
            if SIMPLE(text):
                got = array("I", self.encode_bytes(text.encode())).tobytes()
            else:
                pretokens = self.cut.findall(text)
                if len(pretokens) == 1:
                    got = array("I", self.encode_bytes(text.encode())).tobytes()
                else:
                    got = b"".join(map(self._piece, pretokens))
            if len(text) <= 64:
                if len(self.known) >= WORDS_KEPT:
                    self.known.clear()
                self.known[text] = got
        return got

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that can be encoded apart.

        No pretoken crosses the start of a single blank between two other characters.
        """
        if ODD_SPACES.search(text) is not None:
            return re.split(r"(?<=\S)(?= \S)", text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        whole = self.split_added is None or not any(a in text for a in self.added)
        out = []
        known, piece = self.known, self._piece
        for part in [text] if whole else self.split_added.split(text):
            if part in self.added:
                out.append(array("I", [self.added[part]]).tobytes())
            elif part:
                out += [known.get(p) or piece(p) for p in self.pieces(part) if p]
        return np.frombuffer(b"".join(out), dtype=np.uintc)

    def encode_ids(self, text: str) -> list[int]:
        """Ids of a whole text as a list."""
        return self.encode(text).tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens included."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def coder(content: str) -> PrefixBpe:
    """The worker's coder for a file's contents, built once."""
    return held_in_worker("bpe" + hashlib.sha256(content.encode()).hexdigest(), lambda: PrefixBpe(content))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_texts(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; ``ids`` on request.

    ``vocabulary`` is the path of the file on the driver. The digests are those of the decimal
    ids joined by commas, and of the text decoded from the ids.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    docs = docs.drop(*names)
    others = [f for f in docs.schema.fields if f.name != "text"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]
    schema = T.StructType([*others, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(sent.value)
        for batch in batches:
            ids, ids_sha, text_sha = [], [], []
            for value in batch.column("text"):
                ids.append(bpe.encode(value.as_py() or ""))
                own = ids[-1].tolist()
                ids_sha.append(sha256(",".join(map(bpe.written.__getitem__, own)).encode()))
                text_sha.append(sha256(bpe.decode(own).encode()))
            counts = np.array([len(x) for x in ids], dtype=np.int64)
            columns = [pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate([*ids, np.zeros(0, np.uintc)]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), *columns], names=[f.name for f in others] + names
            )

    return in_tasks(docs, run, schema)
