import gc
import hashlib
import json
import random
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_cases import edge_rows, edges, no_docs  # noqa: F401
from veilspark.llm import prefix_bpe as B
from veilspark.llm import token_files as T
from veilspark.llm.storage import in_tasks

CHARACTERS = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000\u200b\ufeff abcdeÉéßñ漢字ひ😀👍🏽\u0301İſK٣2Ⅷ½²0'st'll..,!?aaa---"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def random_texts(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        text = "".join(rng.choice(CHARACTERS) for _ in range(rng.randint(0, 40)))
        yield text.replace("a", "<|endoftext|>", 1) if k % 4 == 0 else text


@pytest.fixture(scope="module")
def bpe():
    with open(BYTES, encoding="utf-8") as f:
        return B.PrefixBpe(f.read())


def test_bpe_equals_the_library(bpe):
    library = Tokenizer.from_file(BYTES)
    for text in random_texts(4000, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_ids(text) == ids, text
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_every_token_encodes_to_itself(bpe):
    for i, raw in bpe.bytes_of.items():
        if i not in bpe.added.values():
            assert bpe.encode_bytes(raw) == (i,)


def test_bpe_is_linear_in_a_long_run(bpe):
    library = Tokenizer.from_file(BYTES)
    for text in ("a" * 20_000, "ab" * 10_000, " " * 5000, "=" * 9001):
        assert bpe.encode_ids(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_query_rows(edges, no_docs):
    library = Tokenizer.from_file(BYTES)
    rows = B.encode_texts(edges, BYTES, with_ids=True).collect()
    texts = [r.text or "" for r in edges.collect()]
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.encode_texts(no_docs, BYTES).count() == 0


def test_words_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        words = T.Words(f.read(), np.dtype("<u2"))
    texts = list(random_texts(3000, 2))
    for text, got in zip(texts, words.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("layout", [T.Layout(), T.Layout(length=7, sequences=3), T.Layout(length=64, sequences=2, wide=True)])
def test_files_round_trip(spark, edges, layout):
    library = Tokenizer.from_file(WORDS)
    docs = edges.withColumnsRenamed({"place": "part", "start": "at"})
    index = T.write_tokens(docs, WORDS, layout)
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in T.read_tokens(index, layout).collect())
    texts = {}
    for r in edges.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    at = 0
    for (start, i, n, crc), want in zip(got, [g[1] for g in got]):
        ids = np.array(library.encode(texts[want][0], add_special_tokens=False).ids + [2], dtype="<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    order = [g[1] for g in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and len(order) == edges.count()
    # Every id of every file sits in a sequence of full length, and the mask counts the real ones.
    real = 0
    for (uri,) in index.select("file").distinct().collect():
        reader = T.SequenceReader(uri, layout)
        for b in range(reader.file.num_record_batches):
            for row in range(reader.file.get_batch(b).num_rows):
                ids, mask = reader.sequence(b * layout.sequences + row)
                assert len(ids) == len(mask) == layout.length
                real += int(mask.sum())
    assert real == at


def test_no_texts(no_docs):
    assert T.read_tokens(T.write_tokens(no_docs, WORDS)).count() == 0


def test_same_rows_however_dealt(edges):
    a, b = (T.read_tokens(T.write_tokens(edges.repartition(n), WORDS)).agg(F.sum("start"), F.sum("ids_crc32")).first() for n in (1, 5))
    assert a == b


def test_workers_give_back_tables_of_other_operators(edges):
    def probe(batches):
        import gc

        for batch in batches:
            found = sum(type(x).__name__ in ("PrefixBpe", "Words") for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["found"])

    T.read_tokens(T.write_tokens(edges, WORDS)).count()
    B.encode_texts(edges.repartition(4), BYTES).count()
    assert in_tasks(edges.repartition(4).select("text"), probe, "found long").agg(F.max("found")).first()[0] == 0


def test_plain_words_equal_the_library_and_skip_its_other_steps():
    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        words = T.Words(f.read(), np.dtype("<u2"))
    rng = random.Random(4)
    letters = T.LETTERS + "abcdefgh" * 20
    behind = ["", "", ".", "'", "'.", "$$$", ",\"", "_", "-)", "|>", "'s", "!1", "́", "<|endoftext|>", "º", "×"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(behind) for _ in range(4000)]
    made += [*T.LETTERS, "endoftext|>", "ǅ", "İ", "ΑΣ", "ﬁ", "ª", "é", "a" * 3000, "Straße's", "naïve!!"]
    for w, got in zip(made, words.encode(made)):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(w, add_special_tokens=False).ids, w
    asked = []
    words._whole = lambda word: asked.append(word) or b""
    words.encode(["Unseenword, unSeenword. Überunseen unseenWORD"])
    assert set(asked) <= {",", "."} and "unseenword" in words.runs


def test_plain_words_only_for_steps_that_are_known():
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    other = T.Words(json.dumps(spec), np.dtype("<u2"))
    library = Tokenizer.from_str(json.dumps(spec))
    with_token = Tokenizer.from_file(WORDS)
    with_token.add_tokens(["ord,"])
    taken = T.Words(with_token.to_str(), np.dtype("<u2"))
    for w in ("Word,", "ÜBER", "words"):
        assert np.frombuffer(other.encode([w])[0], "<u2").tolist() == library.encode(w, add_special_tokens=False).ids
        assert np.frombuffer(taken.encode([w])[0], "<u2").tolist() == with_token.encode(w, add_special_tokens=False).ids


def test_a_known_word_takes_little_memory(bpe):
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(10)) for _ in range(20_000)})
    bpe.encode(" ".join(words[:100]))
    gc.collect()
    tracemalloc.start()
    bpe.known = {}
    bpe.pairs = dict(bpe.pairs)
    before = tracemalloc.get_traced_memory()[0]
    bpe.encode(" ".join(words))
    gc.collect()
    taken = tracemalloc.get_traced_memory()[0] - before - sys.getsizeof(bpe.pairs)
    tracemalloc.stop()
    assert taken / len(words) < 260
