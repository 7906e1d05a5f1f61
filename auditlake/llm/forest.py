"""Approximate nearest vectors by cosine: a forest of hash prefixes.

Every tree gives each vector a long string of bits, the sides of random planes on which it lies. A tree
is the sorted array of these strings, and a range of the array holds what shares a prefix. A query goes
down each tree to the longest prefix that anything there shares with it, then up all trees together,
bit by bit, and takes in all that shares a prefix so long in any tree; no prefix is ever cut short.

The ascent ends by what was found, not by a number of candidates. Two vectors at an angle lie on one
side of a plane with a known probability. Once what is nearer than the k-th best found so far would have
been missed by all trees at this length of prefix with a probability of at most ``MISS``, the query is
done; as the k-th best only gets better, this holds for the final answer as well. The whole array, which
is the empty prefix, misses nothing. So what is found does not depend on how many rows there are.

Rows are dealt to shards by their ids, and each shard is an index file of its own in the shared folder.
Chunks of queries go through groups of shards, the best so far carried from shard to shard; the best of
the groups are ranked. Sizes of shards and chunks are bounded. Equal vectors of a shard are one entry
with the smallest ids any answer can name, so that many copies cost no more than one.

A vector that is null, empty, all zeros, or holds a null or a component that is not finite takes no
part; shorter vectors count as ended by zeros. Rows without an id take no part. Rows that share an id are
candidates and queries each, but an id stands once in an answer, with its best score, and never in its
own. Fewer candidates than k are all returned, ties go to the smaller id, empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import shared_folder, stored

TREES, BITS = 32, 64
# Probability with which what is nearer than an answer's last may be missed.
MISS = 0.08
# Candidates before an ascent looks at its scores.
FEW = 64
# Rows of a shard at least, bytes of its vectors (as doubles) at most; shards a chunk of queries goes through in one task.
SHARD_ROWS, SHARD_BYTES, TOGETHER = 4096, 1 << 26, 8
# Queries of a chunk, at least (while there are cores to feed) and at most.
CHUNK = (64, 2048)
# No score in single precision is off by more.
_ROUGH = 2e-5
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- bit strings ----------------------------------------------------------------------


@cache
def planes(dimensions: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dimensions, TREES * BITS)).astype(np.float32)


def strings(unit: np.ndarray) -> np.ndarray:
    """Vectors by trees: each vector's bits, the first one highest."""
    found = np.empty((len(unit), TREES), np.uint64)
    for i in range(0, len(unit), 2048):
        sides = unit[i : i + 2048] @ planes(unit.shape[1]) > 0
        found[i : i + 2048] = np.packbits(sides, axis=1).view(">u8")
    return found


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix."""
    differ = a ^ b
    high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, 32 - np.frexp(high.astype(float))[1], 64 - np.frexp(low.astype(float))[1])


def enough(similarity: float, miss: float) -> int:
    """The longest prefix at which all trees together miss what is that similar with at most ``miss``."""
    if similarity == -np.inf:
        return 0
    same = 1 - np.arccos(min(1.0, max(-1.0, similarity))) / np.pi
    each = 1 - miss ** (1 / TREES)
    return BITS if same >= 1 else int(min(BITS, np.log(each) / np.log(max(same, 1e-12))))


# --- one shard ------------------------------------------------------------------------


@dataclass
class Shard:
    """Distinct vectors with their ids, and the sorted arrays of every tree."""

    vectors: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    sorted: np.ndarray
    order: np.ndarray

    def __post_init__(self) -> None:
        self.norms, self.unit = _lengths(self.vectors)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, ids=self.ids, starts=self.starts, sorted=self.sorted, order=self.order)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as held:
            return Shard(**{name: held[name] for name in held.files})

    def range(self, tree: int, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in a tree's array what shares the first ``bits`` begins and ends, for each string."""
        rest = _ALL >> np.uint64(bits) if bits < BITS else np.uint64(0)
        return np.searchsorted(self.sorted[tree], asked & ~rest), np.searchsorted(self.sorted[tree], asked | rest, "right")


def _lengths(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector, and the vectors of length one in single precision."""
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    return norms, (vectors / norms[:, None]).astype(np.float32)


def _evened(vectors: np.ndarray) -> np.ndarray:
    """Very long and very short vectors times a power of two, which changes no cosine."""
    top = np.abs(vectors).max(axis=1)
    odd = (top > 1e100) | (top < 1e-100)
    if odd.any():
        vectors = vectors.copy()
        vectors[odd] = np.ldexp(vectors[odd], -np.frexp(top[odd])[1][:, None])
    return vectors + 0.0  # no zero has a sign


def build(ids: np.ndarray, vectors: np.ndarray, kept: int) -> Shard:
    """The forest of some rows; each distinct vector has its ``kept`` smallest ids."""
    vectors = np.ascontiguousarray(_evened(vectors))
    _, first, group = np.unique(vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    ids, group = ids[order], group[order]
    once = np.append(True, (ids[1:] != ids[:-1]) | (group[1:] != group[:-1]))[: len(ids)]
    ids, group = ids[once], group[once]
    few = np.arange(len(group)) - np.searchsorted(group, group) < kept
    vectors = vectors[first]
    bits = strings(_lengths(vectors)[1])
    sort = np.argsort(bits, axis=0, kind="stable").T.astype(np.int32)
    starts = np.searchsorted(group[few], np.arange(len(vectors) + 1))
    return Shard(vectors, ids[few], starts, np.ascontiguousarray(np.take_along_axis(bits.T, sort, axis=1)), np.ascontiguousarray(sort))


class Asked:
    """A chunk of queries with the best found for each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, miss: float) -> None:
        self.ids, self.vectors, self.k, self.miss = ids, _evened(vectors).astype(float), k, miss
        self.norms, self.unit = _lengths(self.vectors)
        self.strings = strings(self.unit)
        self.best: list[dict[int, float]] = [{} for _ in ids]
        self.limit = np.full(len(ids), -np.inf)
        self.until = np.zeros(len(ids), np.int64)

    def take(self, i: int, shard: Shard, at: np.ndarray) -> None:
        """Score some vectors of a shard for query ``i`` and keep the best."""
        rough = shard.unit[at] @ self.unit[i] if 4 * len(at) < len(shard.unit) else (shard.unit @ self.unit[i])[at]
        least = self.limit[i]
        if len(at) > self.k + 1:
            least = max(least, np.partition(rough, -self.k - 1)[-self.k - 1])
        at = at[rough >= least - _ROUGH]
        exact = (shard.vectors[at].astype(float) * self.vectors[i]).sum(axis=1) / (shard.norms[at] * self.norms[i])
        best = self.best[i]
        for b, e, score in zip(shard.starts[at].tolist(), shard.starts[at + 1].tolist(), exact.tolist(), strict=True):
            for id in shard.ids[b:e].tolist():
                if id != self.ids[i] and best.get(id, -np.inf) < score:
                    best[id] = score
        if len(best) >= self.k:
            self.best[i] = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.k])
            self.limit[i] = min(self.best[i].values())
            self.until[i] = enough(self.limit[i], self.miss)

    def search(self, shard: Shard) -> None:
        """Down each tree, and up all of them together until each query is done."""
        deepest = np.zeros(len(self.ids), np.int64)
        for tree in range(TREES):
            held, own = shard.sorted[tree], self.strings[:, tree]
            at = np.searchsorted(held, own)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(held) - 1)):
                deepest = np.maximum(deepest, shared_bits(held[near], own))
        going, counted = np.ones(len(self.ids), bool), np.zeros(len(self.ids), np.int64)
        mark = np.zeros(len(shard.vectors), bool)
        for bits in range(int(deepest.max(initial=0)), -1, -1):
            rows = np.flatnonzero(going & (deepest >= bits))
            if not len(rows):
                continue
            ranges = [shard.range(tree, self.strings[rows, tree], bits) for tree in range(TREES)]
            begin, end = (np.stack(x, axis=1) for x in zip(*ranges, strict=True))
            counts = (end - begin).sum(axis=1)
            for i, b, e, n in zip(rows.tolist(), begin, end, counts.tolist(), strict=True):
                if n < FEW and bits > self.until[i]:
                    continue
                if n > counted[i]:
                    mark[:] = False
                    for tree in np.flatnonzero(e > b).tolist():
                        mark[shard.order[tree, b[tree] : e[tree]]] = True
                    self.take(i, shard, np.flatnonzero(mark))
                    counted[i] = n
                going[i] = bits > self.until[i]


# --- jobs -----------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """True for vectors of finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    lists = lists.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    found = np.zeros((len(sizes), dimensions), flat.dtype)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return found


@dataclass(frozen=True)
class Forest:
    """A written index: ``shards`` has a row ``(shard, file)`` for each file of the folder."""

    spark: SparkSession
    folder: str
    dimensions: int
    count: int
    most: int
    shards: DataFrame


def _rows(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    held = vectors.schema[vector].dataType.simpleString()
    kind = "array<float>" if held == "array<float>" else "array<double>"
    kept = vectors.filter(F.col(id).isNotNull() & usable(vector))
    return kept.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("values"))


def index(vectors: DataFrame, most: int, id: str = "vec_id", vector: str = "vector") -> Forest:
    """Index every usable row, for answers of up to ``most`` rows."""
    spark = vectors.sparkSession
    folder = shared_folder(spark, "forest")
    rows = _rows(vectors, id, vector)
    count, dimensions = rows.agg(F.count("*"), F.max(F.size("values"))).first()
    dimensions = dimensions or 0
    largest = max(SHARD_ROWS, SHARD_BYTES // (8 * max(1, dimensions)))
    shards = max(-(-count // largest), min(-(-count // SHARD_ROWS), 2 * spark.sparkContext.defaultParallelism))

    def write(table: pa.Table) -> pa.Table:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.npz"
        held = build(table.column("id").to_numpy(), _matrix(table.column("values"), dimensions), most + 1)
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(held.dump())
        return pa.table({"shard": table.column("shard").slice(0, 1), "file": [name]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(max(1, shards))).cast("int"))
    written = stored(dealt.groupBy("shard").applyInArrow(write, "shard int, file string"), "forest-shards")
    return Forest(spark, folder, dimensions, shards, most, written)


def search(forest: Forest, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "vector", miss: float = MISS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query, none of its own id."""
    if k > forest.most:
        raise ValueError(f"the index holds answers of up to {forest.most} rows")
    folder, dimensions = forest.folder, forest.dimensions
    asked = stored(_rows(queries, id, vector), "forest-queries")
    count, widest = asked.agg(F.count("*"), F.max(F.size("values"))).first()
    if widest is not None and widest > dimensions and forest.count:
        raise ValueError(f"a query has {widest} components, the index {dimensions}")
    parts = max(1, -(-forest.count // TOGETHER))
    least, most = (-(-count // size) for size in reversed(CHUNK))
    chunks = max(1, least, min(most, -(-2 * forest.spark.sparkContext.defaultParallelism // parts)))
    files = forest.shards.groupBy((F.col("shard") % parts).alias("part")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    spread = asked.withColumns({"chunk": F.pmod(F.xxhash64("id", "values"), F.lit(chunks)), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})

    def answer(tables: Iterable[pa.Table] | pa.Table) -> pa.Table:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        chunk = Asked(tables.column("id").to_numpy(), _matrix(tables.column("values"), dimensions), k, miss)
        for name in tables.column("files")[0].as_py():
            with system.open_input_file(f"{root}/{name}") as file:
                chunk.search(Shard.load(file.read()))
        rows = [(own, other, score) for own, best in zip(chunk.ids.tolist(), chunk.best, strict=True) for other, score in best.items()]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 3, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    # Few bytes, but much work: the groups are dealt to tasks by number, not by size.
    dealt = spread.join(files, "part").repartition(2 * chunks * parts, "chunk", "part")
    found = dealt.groupBy("chunk", "part").applyInArrow(answer, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
