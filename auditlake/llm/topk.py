"""Exact nearest vectors by inner product, with a branch and bound over blocks of dimensions.

Vectors are packed into blocks in vertical layout: one row of the block's array is one dimension of
all its vectors. For a query the inner products with a block grow dimension block by dimension block.
What the dimensions still to come can add is at most the product of the lengths of both vectors over
them; a candidate whose sum plus that bound falls short of the query's limit is left out, and the
survivors are compacted. The limit is the k-th highest lower bound seen so far, and a candidate that
may tie with it stays.

Every block of queries meets every group of candidates in one task, with the best of the group carried
from block to block; the best of all groups are merged by rank. Sums are exact: vectors so large that
double precision may round are multiplied as whole numbers of any size, and a sum beyond 64 bits counts
as the largest (or least) of 64 bits. A vector that is null, or holds a null or a component that is not
finite takes no part; vectors shorter than the longest count as ended by zeros, empty ones as all zeros. Ties go to the smaller id, also among repeated vectors. Rows without an id take no
part; of rows that share an id each counts. Fewer candidates than k are all returned; empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import stored

# Vectors of a block, blocks' vectors of a group, queries of a block, dimensions summed at once.
BLOCK, GROUP, QUERIES, DIMENSIONS = 4096, 32_768, 512, 16
# Sums of products below this are exact in double precision.
_EXACT = float(1 << 53)
_LARGEST = (1 << 63) - 1


def usable(vectors: DataFrame, vector: str) -> Column:
    """True for vectors all of whose components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def _packed(vectors: DataFrame, per_group: int, per_block: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of vectors in vertical layout, and the number of their groups."""
    groups = max(1, -(-vectors.count() // per_group))
    dealt = vectors.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
            for b, e in zip(cuts, cuts[1:], strict=False):
                for i in range(b, e, per_block):
                    part = batch.slice(i, min(per_block, e - i))
                    ids = part.column("id").to_numpy(zero_copy_only=False)
                    rows = part.column("values")
                    sizes = np.diff(rows.offsets.to_numpy())
                    array = np.zeros((int(sizes.max()), len(ids)))
                    flat = rows.flatten().to_numpy(zero_copy_only=False)
                    owner = np.repeat(np.arange(len(ids)), sizes)
                    array[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = flat
                    kind = "<i2" if np.abs(array).max(initial=0) < 32_768 else "<f8"
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(group[b])], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([kind]), pa.array([array.astype(kind).tobytes()])],
                        names=["group", "ids", "kind", "columns"],
                    )

    rows = dealt.repartition("group").sortWithinPartitions("group").select("group", "id", "values")
    return stored(rows.mapInArrow(pack, "group int, ids binary, kind string, columns binary"), name), groups


def _unpacked(block) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(block.ids, "<i8")
    return ids, np.frombuffer(block.columns, block.kind).reshape(-1, len(ids)).astype(np.float64)


def _fit(columns: np.ndarray, dimensions: int) -> np.ndarray:
    return np.vstack([columns, np.zeros((dimensions - len(columns), columns.shape[1]))]) if len(columns) < dimensions else columns


def _rest(columns: np.ndarray) -> np.ndarray:
    """The length of every vector over the dimensions from each block of dimensions on."""
    squares = np.add.reduceat(columns**2, np.arange(0, len(columns), DIMENSIONS), axis=0)
    return np.vstack([np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1]), np.zeros((1, columns.shape[1]))])


class _Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.queries = k, queries
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def limits(self) -> np.ndarray:
        """The k-th best score of each query, less than any score while it has fewer."""
        found = np.full(self.queries, -np.inf)
        full = np.flatnonzero(np.bincount(self.query, minlength=self.queries) == self.k)
        found[full] = self.score[np.searchsorted(self.query, full, "right") - 1]
        return found

    def add(self, query: np.ndarray, id: np.ndarray, score: np.ndarray) -> None:
        query, id, score = (np.concatenate(x) for x in ((self.query, query), (self.id, id), (self.score, score)))
        order = np.lexsort((id, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        self.query, self.id, self.score = query[rank < self.k], id[order], score[order]


# Sums go on for all queries of the block together while more than this share of pairs is alive.
_DENSE = 0.1


def _whole(columns: np.ndarray) -> np.ndarray:
    """Vectors by dimensions, as whole numbers of any size."""
    return np.array([[int(x) for x in row] for row in columns.T.tolist()], object).reshape(columns.shape[1], len(columns))


def _large(query_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, given: np.ndarray, best: _Best, of: np.ndarray) -> None:
    """Exact sums of some queries (numbers ``of``) with some vectors, one vector of the smaller side at a time."""
    left, right = _whole(asked), _whole(given)

    def add(query: np.ndarray, id: np.ndarray, sums: np.ndarray) -> None:
        other = query_ids[query] != id
        held = [max(-_LARGEST, min(_LARGEST, int(x))) for x in sums[other].tolist()]
        best.add(query[other], id[other], np.array(held, np.int64))

    if len(left) <= len(right):
        for i, row in enumerate(left):
            add(np.full(len(ids), of[i]), ids, right @ row)
    else:
        for id, row in zip(ids, right, strict=True):
            add(of, np.full(len(of), id), left @ row)


def search_block(query_ids: np.ndarray, queries: np.ndarray, blocks, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the k best candidates of some blocks for each query.

    ``queries`` and the blocks' arrays are vertical: dimensions by vectors.
    """
    best = _Best(len(query_ids), k)
    for ids, columns in blocks:
        dimensions = max(len(queries), len(columns), 1)
        asked, given = _fit(queries, dimensions), _fit(columns, dimensions)
        most = np.sqrt(_EXACT / dimensions)
        large_asked, large_given = (np.abs(x).max(axis=0) >= most for x in (asked, given))
        every = np.arange(len(query_ids))
        if large_given.any():
            _large(query_ids, asked, ids[large_given], given[:, large_given], best, every)
        if large_asked.any():
            _large(query_ids, asked[:, large_asked], ids[~large_given], given[:, ~large_given], best, every[large_asked])
        _bounded(query_ids, asked, every[~large_asked], ids[~large_given], given[:, ~large_given], best, k)
    return query_ids[best.query], best.id, best.score


def _bounded(query_ids: np.ndarray, asked: np.ndarray, of_all: np.ndarray, ids: np.ndarray, given: np.ndarray, best: _Best, k: int) -> None:
    """Branch and bound of some queries (numbers ``of_all``) over a block in which all sums are exact."""
    asked = asked[:, of_all]
    # The bounds are rounded up a little, so that no sum they stand for can exceed them.
    asked_rest, given_rest = _rest(asked) * (1 + 1e-9), _rest(given)
    limits = best.limits()[of_all]
    sums = np.where(ids[None, :] == query_ids[of_all][:, None], -np.inf, 0.0)
    of, at = None, np.arange(len(ids))
    for step in range(len(asked_rest) - 1):
        these = slice(step * DIMENSIONS, (step + 1) * DIMENSIONS)
        if of is None:
            sums += asked[these].T @ given[these][:, at]
            spare = np.outer(asked_rest[step + 1], given_rest[step + 1, at])
            if len(at) > k and not np.isfinite(limits).all():
                limits = np.maximum(limits, np.partition(sums - spare, -k, axis=1)[:, -k])
            alive = sums + spare >= np.maximum(limits, -np.finfo(float).max)[:, None]
            if alive.size and alive.mean() > _DENSE and step < len(asked_rest) - 2:
                used = alive.any(axis=0)
                at, sums = at[used], sums[:, used]
                continue
            of, where = np.nonzero(alive)
            sums, at = sums[of, where], at[where]
        else:
            sums = sums + np.einsum("ij,ij->j", asked[these][:, of], given[these][:, at])
            alive = sums + asked_rest[step + 1, of] * given_rest[step + 1, at] >= limits[of]
            of, at, sums = of[alive], at[alive], sums[alive]
    best.add(of_all[of], ids[at], sums.astype(np.int64))


def search(vectors: DataFrame, is_query: Column, k: int, id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The ``k`` candidates with the highest inner product for each query, itself left out.

    ``vectors`` holds arrays of whole numbers as doubles; ``is_query`` marks the queries among them.
    """
    kept = vectors.filter(F.col(id).isNotNull() & usable(vectors, vector))
    rows = kept.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("values"), is_query.alias("asked"))
    candidates, groups = _packed(rows.drop("asked"), GROUP, BLOCK, "candidates")
    queries, asked = _packed(rows.filter("asked").drop("asked"), QUERIES, QUERIES, "queries")
    left = queries.withColumns({"q": F.col("group"), "c": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    right = candidates.withColumns({"c": F.col("group"), "q": F.explode(F.sequence(F.lit(0), F.lit(asked - 1)))})

    def meet(key: tuple, asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        blocks = [_unpacked(b) for b in given.itertuples()]
        found = [search_block(*_unpacked(b), blocks, k) for b in asked.itertuples()]
        query, id, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"query_id": query, "vec_id": id, "score": score.astype(np.int64)})

    pairs = left.groupBy("q", "c").cogroup(right.groupBy("q", "c"))
    scored = pairs.applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
