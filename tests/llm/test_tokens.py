"""BPE, token files and the arrays of words they and others are made from."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from auditlake.llm import bpe, tokenfiles
from auditlake.llm.tokens import shingles, words
from tokenizers import Tokenizer

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SIGNS = list("abz ''  \n\t\r'sS'rReve'll'd'T.,!1２½é߿ñ 　\u0085 İΣςß漢字😀ǅⅧK") + [
    "<|endoftext|>", "<|startoftext|>", "'s", "'re", " '", "​", "́",
]


def noise(n, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choice(SIGNS) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def test_words_and_shingles():
    hashes, offsets = words(["A b  a", "", "b, a!", "İ12x"])
    assert offsets.tolist() == [0, 3, 3, 5, len(hashes)]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[0]
    found, starts = shingles(hashes[:5], np.array([0, 3, 3, 5]), 2)
    assert starts.tolist() == [0, 2, 2, 3] and found[1] == found[2] != found[0]
    assert np.diff(shingles(hashes[:5], np.array([0, 3, 3, 5]), 5)[1]).tolist() == [1, 0, 1]


def test_byte_merges_equal_the_library():
    library, own, texts = Tokenizer.from_file(BYTE), bpe.Merger(BYTE), noise(4000)
    for ids, expected in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids
        assert own.decode(ids) == library.decode(expected.ids, skip_special_tokens=False)


def test_one_very_long_word_and_bytes_that_are_no_text():
    own, library = bpe.Merger(BYTE), Tokenizer.from_file(BYTE)
    long = "ab" * 20_000
    assert np.frombuffer(next(own.encode([long])), "<u4").tolist() == library.encode(long).ids
    assert own.decode(np.array([own.byte_ids[0xC3]], "<u4").tobytes()) == "�"


def test_encode_and_decode_frames(spark, docs):
    rows = [(1, "Hello hello"), (None, None), (1, "Hello hello"), (3, ""), (4, "x" * 5000 + " <|endoftext|>")]
    library = Tokenizer.from_file(BYTE)
    encoded = bpe.encode(docs(rows).withColumnRenamed("lang", "ids"), BYTE)
    found = bpe.digests(bpe.decode(encoded.withColumnRenamed("source", "decoded"), BYTE))
    expected = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == sorted(expected, key=str)
    assert bpe.decode(bpe.encode(docs([]), BYTE), BYTE).count() == 0


def test_words_equal_the_library():
    library, own, texts = Tokenizer.from_file(WORD), tokenfiles.WordEncoder(WORD), noise(4000)
    for ids, expected in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == expected.ids


class Counted(dict):
    """Counts how often it is asked for a key."""

    looked = 0

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.looked += 1
        return super().__contains__(key)

    def get(self, key, default=None):
        self.looked += 1
        return super().get(key, default)


def test_remembered_words_are_looked_up_once(monkeypatch):
    own = tokenfiles.WordEncoder(WORD)
    first = list(own.encode(["one two three"]))
    own.known = Counted(own.known)
    assert list(own.encode(["one two three"])) == first and own.known.looked == len(own.known)
    # Words of the generation before, and of none.
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 50)
    library, texts = Tokenizer.from_file(WORD), noise(600)
    for i in range(0, 600, 20):
        expected = library.encode_batch(texts[i : i + 20], add_special_tokens=False)
        assert [np.frombuffer(ids, "<u2").tolist() for ids in own.encode(texts[i : i + 20])] == [e.ids for e in expected]


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000])
def test_perfect_hash(n):
    key = np.sort(np.random.default_rng(n).choice(np.arange(-(10**6), 10**6), n, replace=False))
    record = tokenfiles.Record(tokenfiles.build(key, np.arange(n) // 7, np.arange(n) * 5, np.arange(n) % 9))
    slots = record.slots(key)
    assert sorted(slots.tolist()) == list(range(n))
    assert record.first[slots].tolist() == (np.arange(n) * 5).tolist()
    assert (record.slots(key + 10**7) == -1).all()


def expected_files(rows):
    library, at, found = Tokenizer.from_file(WORD), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return found


def test_token_files(spark, docs):
    rows = [(i * 7919 % 1000, f"Text {i} of many!") for i in range(200)]
    rows += [(5, "one"), (5, "two"), (5, "two"), (None, None), (-3, ""), (2000, "long " * 3000)]
    files = tokenfiles.write(docs(rows), WORD, 2)
    found = tokenfiles.fetch(files, docs(rows).select("doc_id").distinct())
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found.collect()]
    assert sorted(got, key=lambda r: r[1]) == expected_files(rows)
    absent = spark.createDataFrame([(10**9,), (-5,)], "doc_id bigint")
    assert tokenfiles.fetch(files, absent).count() == 0


def test_token_files_of_an_empty_table(docs):
    files = tokenfiles.write(docs([]), WORD, 2)
    assert tokenfiles.fetch(files, docs([(1, "a")])).count() == 0
