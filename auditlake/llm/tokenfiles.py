"""Token ids in binary files, with a minimal perfect hash index from document keys to their place.

Layout of a folder: ``shards/*.ids`` hold nothing but ids, little-endian, two bytes each where the
vocabulary allows it and else four, in ascending order of the keys; ``index/*.mph`` hold the index.
Keys are dealt to buckets of about ``BUCKET`` keys by their hash. A bucket's record is a minimal
perfect hash of its keys (levels of bit arrays: a key is placed on the first level where no other one
falls on its bit, and the rank of that bit is its slot) and, by slot, a fingerprint, the shard, the
offset of the key's first id and the lengths of its documents. A look-up reads the record of one
bucket, tries the levels, compares the fingerprint and knows file, offset and length.

Null texts count as empty: they hold the end id alone. A null key is written and indexed as the least
64-bit integer and comes back as null. Documents that share a key lie side by side in the order of
their ids' bytes, and a look-up returns a row for each. An empty table makes no files and no rows. Columns
other than key and text are not read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.pretokens import folds_oddly, lowered, pieces, spread, word_cuts
from auditlake.llm.shared import shared_folder, stored
from auditlake.llm.tokens import SPACE, classes, code_points, mix, slices

# Keys of an index bucket, on average.
BUCKET = 4096
# Stands for a null key.
NULL_KEY = -(1 << 63)
# Distinct words one Python worker remembers in each of two generations.
REMEMBERED = 250_000
# Words encoded as one text.
JOINED = 1000
# Bytes of ids put out together.
TOGETHER = 1 << 22


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once per batch.

    Only texts whose words the library would cut elsewhere than ``word_cuts`` does (special tokens,
    text that is not in composed form, letters with odd lower case) are given to it whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for held in (self.library, self.plain):
            held.no_truncation()
            held.no_padding()
        # For words that are cut already, lowered and in composed form, the rest of the preparation does nothing.
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(r"\s+"), "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ])
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        suffix = self.library.model.end_of_word_suffix
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.library.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from many words encoded as one text and cut where words end."""
        found: list[bytes] = []
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.width
            data = ids.tobytes()
            blank = [classes()[ord(w[0])] == SPACE for w in part]
            if len(ends) + sum(blank) != len(part):
                found += self._packed(part)
                continue
            cuts, begin = iter(ends.tolist()), 0
            for none in blank:
                end = begin if none else next(cuts)
                found.append(data[begin:end])
                begin = end
        return found

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: most are remembered, and looked up once."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, words))
        left = [i for i, held in enumerate(ids) if held is None]
        for i in left:
            ids[i] = self.older.get(words[i])
        new = [i for i in left if ids[i] is None]
        for i, made in zip(new, self._words([words[i] for i in new]), strict=True):
            ids[i] = made
        self.known.update((words[i], ids[i]) for i in left)
        return ids

    def _odd(self, texts: list[str]) -> list[bool]:
        points, starts = code_points(texts)
        folds = np.concatenate(([0], np.cumsum(folds_oddly()[points])))
        odd = folds[starts[1:]] > folds[starts[:-1]]
        return [
            bool(f) or any(s in t for s in self.special) or not unicodedata.is_normalized("NFC", t)
            for f, t in zip(odd, texts, strict=True)
        ]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for _, part in slices(texts):
            odd = self._odd(part)
            whole = iter(self._packed([t for t, o in zip(part, odd, strict=True) if o]))
            plain = lowered(["" if o else t for t, o in zip(part, odd, strict=True)])
            distinct, numbers, offsets = pieces(plain, word_cuts)
            flat, ends = spread(numbers, self._ids(distinct), self.width)
            bounds = ends[offsets]
            for i, o in enumerate(odd):
                yield next(whole) if o else flat[bounds[i] : bounds[i + 1]].tobytes()


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class TokenFiles:
    """A written folder; the tables have a row per shard, and a row per index bucket."""

    spark: SparkSession
    folder: str
    width: int
    buckets: int
    shards: DataFrame
    directory: DataFrame


def write(documents: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every text, append ``end_id``, and write ids and index to a new shared folder."""
    spark = documents.sparkSession
    folder = shared_folder(spark, "token-files")
    files, root = _open(folder)
    for name in ("shards", "index"):
        files.create_dir(f"{root}/{name}")
    rows = documents.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)).alias("key"), F.col(text).alias("text"))
    width = encoder(path).width
    # Ranges are chosen by the keys alone, and ids are exchanged, not texts.
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / count for i in range(1, count)]
    found = rows.agg(F.percentile_approx("key", steps, 100 * count)).first()[0] if steps else None
    bounds = np.array(found or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            begin, held, size = 0, [], 0
            keys = batch.column("key")
            for i, ids in enumerate(encoder(path).encode([t or "" for t in batch.column("text").to_pylist()]), start=1):
                held.append(ids + end)
                size += len(ids)
                if size >= TOGETHER or i == len(batch):
                    part = keys.slice(begin, len(held))
                    ranges = np.searchsorted(bounds, part.to_numpy(), "left").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part, pa.array(ranges), pa.array(held, pa.binary())], names=["key", "range", "ids"])
                    begin, held, size = i, [], 0

    ordered = rows.mapInArrow(encode, "key bigint, range int, ids binary").repartitionById(count, "range").sortWithinPartitions("key", "ids")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        shard, name = TaskContext.get().partitionId(), f"shards/{uuid.uuid4().hex}.ids"
        out, at = None, 0
        for batch in batches:
            out = out or files.open_output_stream(f"{root}/{name}")
            ids = batch.column("ids")
            lengths = np.diff(np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)) // width
            out.write(b"".join(ids.to_pylist()))
            first = at + np.cumsum(np.append(0, lengths.astype(np.int64)))
            at = int(first[-1])
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(first[:-1]), pa.array(lengths, pa.int64())],
                names=["key", "shard", "file", "first", "length"],
            )
        if out:
            out.close()

    places = stored(ordered.mapInArrow(write_shard, "key bigint, shard int, file string, first bigint, length bigint"), "places")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = places.groupBy("shard").agg(F.min("file").alias("file"), F.sum("length").alias("size"), F.count("*").alias("documents"))
    shards = stored(sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))), "shards")
    total = shards.agg(F.sum("documents")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    keyed = places.drop("file").withColumn("bucket", _bucket(buckets))
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "key", "shard", "first")

    def write_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        name, out, at = f"index/{uuid.uuid4().hex}.mph", None, 0
        for bucket, columns in _by_bucket(batches, ("key", "shard", "first", "length")):
            out = out or files.open_output_stream(f"{root}/{name}")
            record = build(*columns)
            out.write(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(record)], pa.int64())],
                names=["bucket", "index_file", "index_at", "index_bytes"],
            )
            at += len(record)
        if out:
            out.close()

    directory = dealt.mapInArrow(write_index, "bucket bigint, index_file string, index_at bigint, index_bytes bigint")
    return TokenFiles(spark, folder, width, buckets, shards, stored(directory, "directory"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("bigint")


def _by_bucket(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each bucket, from batches in the order of buckets."""
    held: list[list[np.ndarray]] = []
    current = None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        for b, e in zip(cuts, cuts[1:], strict=False):
            if b == e:
                continue
            if held and bucket[b] != current:
                yield int(current), [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            current = bucket[b]
            held.append([c[b:e] for c in columns])
    if held:
        yield int(current), [np.concatenate(c) for c in zip(*held, strict=True)]


# --- the minimal perfect hash of one bucket -----------------------------------------

_SEED = 0xA0761D6478BD642F


def _hashed(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ np.uint64((_SEED * (level + 1)) % (1 << 64)))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hashed(keys, -2) >> np.uint64(32)).astype("<u4")


def build(key: np.ndarray, shard: np.ndarray, first: np.ndarray, length: np.ndarray) -> bytes:
    """The record of a bucket; rows come by key, shard and first id."""
    key = np.ascontiguousarray(key, np.int64)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    keys = key[start]
    slots, sizes, bits = np.full(len(keys), -1, np.int64), [], []
    left, placed = np.arange(len(keys)), 0
    while len(left):
        size = -(-max(8, len(left) * 3 // 2) // 8) * 8
        at = (_hashed(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        won = alone[at]
        slots[left[won]] = placed + (np.cumsum(alone) - 1)[at[won]]
        placed += int(won.sum())
        left = left[~won]
    order = np.empty(len(keys), np.int64)
    order[slots] = np.arange(len(keys))
    stop = np.append(start[1:], len(key))
    docs = np.concatenate(([0], np.cumsum((stop - start)[order])))
    within = np.repeat(start[order] - docs[:-1], np.diff(docs)) + np.arange(len(key))
    return b"".join((
        struct.pack("<3I", len(keys), len(sizes), len(key)),
        np.array(sizes, "<u4").tobytes(),
        np.packbits(np.concatenate([np.zeros(0, bool), *bits])).tobytes(),
        _fingerprints(keys)[order].tobytes(),
        shard[start][order].astype("<i4").tobytes(),
        first[start][order].astype("<i8").tobytes(),
        docs.astype("<u4").tobytes(),
        length[within].astype("<i8").tobytes(),
    ))


class Record:
    """A bucket's record, ready for look-ups."""

    def __init__(self, data: bytes) -> None:
        n, levels, documents = struct.unpack_from("<3I", data)
        at = 12

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.sizes = take("<u4", levels).tolist()
        self.bits = np.unpackbits(take("u1", sum(self.sizes) // 8)).astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.fingerprint, self.shard, self.first = take("<u4", n), take("<i4", n), take("<i8", n)
        self.docs, self.length = take("<u4", n + 1).astype(np.int64), take("<i8", documents)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that was not indexed (but for one in four billion)."""
        keys = np.ascontiguousarray(keys, np.int64)
        found, base, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = base + (_hashed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += size
        if not len(self.fingerprint):
            return np.full(len(keys), -1, np.int64)
        found[self.fingerprint[found] != _fingerprints(keys)] = -1
        return found


# --- reading --------------------------------------------------------------------------


def locate(files: TokenFiles, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shard, first id and length of every document of the given keys, from the index files."""
    wanted = keys.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)).alias("key"))
    dealt = wanted.withColumn("bucket", _bucket(files.buckets)).repartition("bucket")
    rows = dealt.join(files.directory, "bucket").sortWithinPartitions("bucket")
    folder = files.folder

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for _, (key, name, at, size) in _by_bucket(batches, ("key", "index_file", "index_at", "index_bytes")):
            with system.open_input_file(f"{root}/{name[0]}") as file:
                record = Record(file.read_at(int(size[0]), int(at[0])))
            slots = record.slots(key)
            key, slots = key[slots >= 0], slots[slots >= 0]
            counts = record.docs[slots + 1] - record.docs[slots]
            ends = np.cumsum(counts)
            doc = np.repeat(record.docs[slots] - (ends - counts), counts) + np.arange(int(counts.sum()))
            length = record.length[doc]
            # A key's documents follow each other: each starts where the one before it ends.
            run = np.concatenate(([0], np.cumsum(length)))[:-1]
            first = np.repeat(record.first[slots] - run[ends - counts] if len(doc) else slots, counts) + run
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, counts)), pa.array(np.repeat(record.shard[slots], counts)), pa.array(first), pa.array(length)],
                names=["key", "shard", "first", "length"],
            )

    return rows.select("bucket", "key", "index_file", "index_at", "index_bytes").mapInArrow(
        look_up, "key bigint, shard int, first bigint, length bigint"
    )


def fetch(files: TokenFiles, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the given keys: place, and ids as little-endian unsigned 32-bit numbers."""
    folder, width = files.folder, files.width
    shards = files.shards.select("shard", "file", "base")
    count = max(1, files.shards.count())
    placed = locate(files, keys, key).join(F.broadcast(shards), "shard")
    rows = placed.repartitionById(count, "shard").sortWithinPartitions("shard", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name, file = None, None
        for batch in batches:
            ids = []
            for at, size, wanted in zip(batch.column("first").to_pylist(), batch.column("length").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if wanted != name:
                    name, file = wanted, system.open_input_file(f"{root}/{wanted}")
                data = file.read_at(size * width, at * width)
                ids.append(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            yield batch.select(["key", "shard", "base", "first", "length"]).append_column("ids", pa.array(ids, pa.binary()))

    found = rows.select("key", "shard", "base", "first", "length", "file").mapInArrow(
        read, "key bigint, shard int, base bigint, first bigint, length bigint, ids binary"
    )
    return found.select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias(key),
        "shard",
        (F.col("base") + F.col("first")).alias("start"),
        F.col("length").alias("n_tokens"),
        "ids",
    )
