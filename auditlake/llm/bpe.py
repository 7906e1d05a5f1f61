"""Byte pair encoding and decoding with the vocabulary of a byte-level tokenizer.

Each distinct piece of text is merged once per batch: its symbols form a doubly linked list, the ranks
of neighbouring pairs a priority queue; the lowest rank is merged first, and entries whose pair has
changed since are skipped. Decoding joins the byte strings of the vocabulary.

Null texts count as empty and have no tokens. A special token's own string inside a text is that token,
as the library reads it. Texts of any length are encoded whole. Rows are independent: ties, repeated
rows and empty tables need no rule, and other columns are kept as they are; a column named like a new
one is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.pretokens import byte_level_cuts, pieces, spread
from auditlake.llm.tokens import slices

# Distinct pieces one Python worker remembers in each of two generations; pieces in use outlive a change.
REMEMBERED = 120_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b if b in printable else next(shifted)) for b in range(256)]


class Merger:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary: dict[str, int] = held["model"]["vocab"]
        letters = _byte_letters()
        value = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [vocabulary[letter] for letter in letters]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.special_ids = {content: np.uint32(i).tobytes() for content, i in self.special.items()}
        self.around_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in vocabulary.items():
            if all(c in value for c in token):
                self.strings[i] = bytes(value[c] for c in token)
        for content, i in self.special.items():
            self.strings[i] = content.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(held["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit numbers."""
        symbols = [self.byte_ids[b] for b in piece.encode()]
        size = len(symbols)
        if size > 1:
            merge_of, pop, push = self.merges.get, heapq.heappop, heapq.heappush
            before, after = list(range(-1, size - 1)), list(range(1, size + 1))
            queue = [
                found[0] << 32 | i
                for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
                if (found := merge_of(pair))
            ]
            heapq.heapify(queue)
            while queue:
                entry = pop(queue)
                i = entry & 0xFFFFFFFF
                j = after[i]
                if symbols[i] < 0 or j >= size:
                    continue
                found = merge_of((symbols[i], symbols[j]))
                if found is None or found[0] != entry >> 32:
                    continue
                symbols[i], symbols[j] = found[1], -1
                k = after[i] = after[j]
                if k < size:
                    before[k] = i
                    if found := merge_of((symbols[i], symbols[k])):
                        push(queue, found[0] << 32 | i)
                if (h := before[i]) >= 0 and (found := merge_of((symbols[h], symbols[i]))):
                    push(queue, found[0] << 32 | h)
            symbols = [s for s in symbols if s >= 0]
        return struct.pack(f"<{len(symbols)}I", *symbols)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, one after the other."""
        for _, part in slices(texts):
            cut, marks = [], []
            for text in part:
                split = self.around_special.split(text) if self.around_special and any(s in text for s in self.special) else [text]
                cut += split[::2]
                marks.append(split[1::2])
            distinct, numbers, offsets = pieces(cut, byte_level_cuts)
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            parts = []
            known, older = self.known, self.older
            for piece in distinct:
                ids = known.get(piece)
                if ids is None:
                    ids = known[piece] = older.get(piece) or self.merge(piece)
                parts.append(ids)
            flat, ends = spread(numbers, parts, 4)
            bounds, i = ends[offsets], 0
            for inner in marks:
                ids = flat[bounds[i] : bounds[i + 1]].tobytes()
                for k, mark in enumerate(inner, start=1):
                    ids += self.special_ids[mark] + flat[bounds[i + k] : bounds[i + k + 1]].tobytes()
                i += len(inner) + 1
                yield ids

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def merger(path: str) -> Merger:
    return Merger(path)



Batches = Iterator[pa.RecordBatch]


def _encoding(path: str, text: str, ids: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            values = [t or "" for t in batch.column(text).to_pylist()]
            kept = batch.drop_columns([text])
            begin = 0
            for done in _groups(merger(path).encode(values)):
                part = kept.slice(begin, len(done))
                begin += len(done)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], names=[*part.schema.names, ids])

    return run


def _decoding(path: str, ids: str, text: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            begin = 0
            for done in _groups(merger(path).decode(x or b"") for x in batch.column(ids).to_pylist()):
                part = batch.slice(begin, len(done))
                begin += len(done)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.string())], names=[*part.schema.names, text])

    return run


def _schema(rows: DataFrame, drop: str, **added: T.DataType) -> T.StructType:
    kept = [f for f in rows.schema.fields if f.name != drop]
    return T.StructType([*kept, *(T.StructField(name, kind) for name, kind in added.items())])


def encode(texts: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace column ``text`` by ``ids``: a binary column of little-endian unsigned 32-bit ids.

    ``path`` is a byte-level tokenizer file that every executor has.
    """
    rows = texts.drop(ids) if ids != text else texts
    return rows.mapInArrow(_encoding(path, text, ids), _schema(rows, text, **{ids: T.BinaryType()}))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add column ``text``: the string of the ids, special tokens included."""
    rows = tokens.drop(text)
    return rows.mapInArrow(_decoding(path, ids, text), _schema(rows, "", **{text: T.StringType()}))


def round_trip(texts: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode``, by the same Python workers."""
    rows = texts.drop(*{ids, decoded} - {text})
    there, back = _encoding(path, text, ids), _decoding(path, ids, decoded)
    schema = _schema(rows, text, **{ids: T.BinaryType(), decoded: T.StringType()})
    return rows.mapInArrow(lambda batches: back(there(batches)), schema)


def _groups(values: Iterator, most: int = 1 << 22) -> Iterator[list]:
    """Lists of values of about ``most`` bytes together, so that no large batch is built."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def digests(tokens: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text, in place of both."""
    return tokens.withColumns({
        "n_tokens": (F.octet_length(ids) / 4).cast("bigint"),
        "ids_sha256": F.sha2(ids, 256),
        "decoded_sha256": F.sha2(F.col(text).cast("binary"), 256),
    }).drop(ids, text)
