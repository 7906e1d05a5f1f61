"""Near-duplicate texts: Jaccard similarity of word shingles, with Bayesian pruning of candidates.

Equal texts are one node with a number of copies. A node's signature holds ``BANDS`` times ``ROWS``
minimum hashes of its shingles; nodes with equal values in a band share a bucket. The pairs of a small
bucket are compared value by value: after each ``STEP`` values, a pair goes when the probability that
its similarity reaches the threshold, given the values that agreed so far and an even prior, is below
``TOLERANCE``. Nodes of a large bucket are taken as one family instead, so that no bucket is ever
expanded into pairs. Families, the components of what is left, are dealt in pairs of bounded blocks;
there every pair is pruned once more by the same rule and those that remain are verified exactly on the
sets of shingles. Blocks put out sums and a spanning forest, not pairs.

A pair at the threshold misses all bands with a probability of about 3e-6 and is pruned with one of
about 1e-6; the more similar, the less.

Null texts count as empty. A text of fewer words than a shingle has has one shingle, of all its words;
a text without words is linked to its copies only. Documents without an id take part as others do.
Texts are read whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.graph import components
from auditlake.llm.shared import stored
from auditlake.llm.tokens import mix, shingles, slices, words

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 24, 4, 16, 1e-7
VALUES = BANDS * ROWS
# Buckets of more nodes become families without comparing pairs; shingles and members of a block.
SMALL_BUCKET, BLOCK_SHINGLES, BLOCK_MEMBERS = 16, 100_000, 2000


# --- signatures and the rule for pruning ----------------------------------------------


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64))
    return seeds[:VALUES] | np.uint64(1), seeds[VALUES:]


def signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles of each text that has any."""
    some = np.flatnonzero(np.diff(starts))
    result = np.zeros((len(some), VALUES), "<u4")
    if len(some):
        for i, (factor, term) in enumerate(zip(*_functions(), strict=True)):
            values = ((found * factor + term) >> np.uint64(32)).astype(np.uint32)
            result[:, i] = np.minimum.reduceat(values, starts[some])
    return result


@cache
def least_matches(similarity: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared, how many must agree for a pair to stay.

    With m of n values equal and an even prior, P(similarity >= t) is P(Binomial(n + 1, t) <= m).
    """
    least = {}
    for n in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, 0
        while (below := below + comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)) < tolerance:
            m += 1
        least[n] = m
    return least


def surviving(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of two arrays of signatures stay when they are compared step by step."""
    alive = np.arange(len(left))
    agreed = np.zeros(len(left), np.int32)
    for n, least in least_matches(similarity).items():
        step = slice(n - STEP, n)
        agreed = agreed + (left[alive, step] == right[alive, step]).sum(axis=1)
        stay = agreed >= least
        alive, agreed = alive[stay], agreed[stay]
    return alive


# --- families -------------------------------------------------------------------------


def _signed(documents: DataFrame, id: str, text: str, width: int) -> DataFrame:
    @F.arrow_udf("struct<n: int, signature: binary>")
    def sign(values: pa.Array) -> pa.Array:
        counts, rows = [], []
        for _, part in slices(values.to_pylist()):
            found, starts = shingles(*words(part), width)
            lengths = np.diff(starts)
            made = iter(signatures(found, starts))
            counts += lengths.tolist()
            rows += [next(made).tobytes() if n else None for n in lengths]
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(rows, pa.binary())], names=["n", "signature"])

    whole = documents.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = whole.select("id", F.unhex(F.md5("text")).alias("key"), sign.asNondeterministic()("text").alias("s"))
    return stored(signed.select("id", "key", "s.n", "s.signature"), "signed")


def _nodes(signed: DataFrame) -> DataFrame:
    """A row per distinct text, with a number of its own that is written down."""
    once = signed.groupBy("key").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    return stored(once.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between nodes of large buckets, and the distinct pairs of small ones."""
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("signature", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))
    rows = nodes.filter("n > 0").select("node", F.explode(bands).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    members = stored(rows.join(shared, "bucket"), "members")
    large = members.filter(F.col("size") > SMALL_BUCKET).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    small = members.filter(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    ahead = small.select("nodes", F.posexplode("nodes").alias("i", "a"))
    pairs = ahead.select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("b"))
    return large, pairs.distinct()


def _pruned(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, VALUES) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).take(pa.array(surviving(*sides, similarity)))

    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


# --- exact verification ---------------------------------------------------------------


class _Member:
    __slots__ = ("copies", "node", "part", "set", "signature")

    def __init__(self, node, part, copies, signature, found) -> None:
        self.node, self.part, self.copies, self.signature, self.set = node, part, copies, signature, found


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of common shingles of each pair of sets."""
    if len(left) <= 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Columns are numbered anew for shingles of two sets or more; others are in no intersection.
    kept = held[column] > 1
    number = np.cumsum(held > 1) - 1
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    wide = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        b, e = np.searchsorted(column, (first, first + wide))
        array = np.zeros((len(sets), wide), np.float32)
        array[owner[b:e], column[b:e] - first] = 1
        total += array @ array.T
    return total[left, right].astype(np.int64)


def _verified(members: list[_Member], lo: int, hi: int, similarity: float) -> list[tuple[int, int, int]]:
    """``(node, root, links)`` of the nodes of two blocks that have links between the blocks."""
    members = list({m.node: m for m in members}.values())
    part = np.array([m.part for m in members])
    signature = np.stack([m.signature for m in members])
    rows = np.flatnonzero(part == lo)
    columns = np.flatnonzero(part == hi)
    found_left, found_right = [], []
    for i in rows:
        others = columns if lo != hi else columns[columns > i]
        if len(others):
            stay = surviving(np.broadcast_to(signature[i], (len(others), VALUES)), signature[others], similarity)
            found_left.append(np.full(len(stay), i))
            found_right.append(others[stay])
    if not found_left:
        return []
    left, right = np.concatenate(found_left), np.concatenate(found_right)
    sizes = np.array([len(m.set) for m in members])
    common = _common([m.set for m in members], left, right)
    near = common >= similarity * (sizes[left] + sizes[right] - common) - 1e-9
    left, right = left[near], right[near]
    copies = np.array([m.copies for m in members])
    links = np.bincount(left, copies[right], len(members)) + np.bincount(right, copies[left], len(members))
    root = list(range(len(members)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)
    return [(members[i].node, members[top(i)].node, int(links[i])) for i in np.flatnonzero(links)]


def _verify(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Member] = []
        current = None

        def made() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (rows := _verified(held, current[1], current[2], similarity)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "root", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "lo", "hi")), strict=True))
            nodes, parts, copies, marks = (batch.column(c).to_pylist() for c in ("node", "part", "copies", "signature"))
            for first, texts in slices(batch.column("text").to_pylist()):
                found, starts = shingles(*words(texts), width)
                for i in range(len(texts)):
                    k = first + i
                    if keys[k] != current:
                        yield from made()
                        held, current = [], keys[k]
                    own = np.unique(found[starts[i] : starts[i + 1]])
                    held.append(_Member(nodes[k], parts[k], copies[k], np.frombuffer(marks[k], "<u4"), own))
        yield from made()

    return run


def _blocks(sized: DataFrame) -> DataFrame:
    """The number of blocks of each family of nodes with ``n`` shingles, bounded by shingles and by members."""
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS))
    return sized.groupBy("family").agg(blocks.cast("int").alias("blocks"))


def _classes(documents: DataFrame, id: str, text: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """A row per document with the key of its text; a row per distinct text with its class and links."""
    signed = _signed(documents, id, text, width)
    nodes = _nodes(signed)
    large, pairs = _candidates(nodes)
    links = large.unionByName(_pruned(pairs, nodes, similarity))
    families = stored(components(links).select("node", F.col("root").alias("family")), "families")

    sized = families.join(nodes.select("node", "key", "n", "copies", "signature", "first_id"), "node")
    blocks = _blocks(sized)
    whole = documents.select(F.col(id).cast("bigint").alias("first_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The text of a node is that of its first document.
    keyed = whole.withColumn("key", F.unhex(F.md5("text")))
    same = keyed["key"].eqNullSafe(sized["key"]) & keyed["first_id"].eqNullSafe(sized["first_id"])
    members = keyed.join(sized, same).select("node", "family", "copies", "signature", "text")
    placed = members.join(blocks, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "part", "copies", "signature", "text"
    )
    ordered = dealt.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    verified = stored(ordered.mapInArrow(_verify(width, similarity), "node bigint, root bigint, links bigint"), "verified")

    roots = components(verified, "node", "root")
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = roots.join(linked, "node").join(nodes.select("node", "key", "first_id", "copies"), "node")
    least = known.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = known.join(least, "root").select("node", "root", "class_id", "links")
    every = nodes.select("node", "key", "first_id", "copies").join(classes, "node", "left").select(
        "key", "node", "first_id", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "first_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return signed, every


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: ``class_id``, the least id of its class, and ``n_links``, the number of other
    documents whose similarity to it reaches the threshold."""
    signed, every = _classes(documents, id, text, width, similarity)
    return signed.select("id", "key").join(every, "key").select(F.col("id").alias(id), "class_id", "n_links")


def one_of_each(documents: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the least id; all columns are kept."""
    _, every = _classes(documents, id, text, width, similarity)
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node", "key")
    chosen = every.groupBy("root").agg(F.min(order).alias("c")).select(F.col("c.first_id").alias("_id"), F.col("c.key").alias("_key"))
    keyed = documents.withColumn("_text_key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    same = keyed[id].cast("bigint").eqNullSafe(chosen["_id"]) & (keyed["_text_key"] == chosen["_key"])
    # Repeated rows have id and text in common.
    return keyed.join(chosen, same, "left_semi").dropDuplicates([id, "_text_key"]).select(documents.columns)
