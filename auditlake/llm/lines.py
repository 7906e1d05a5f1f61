"""Lines that repeat within or across documents, exactly or but for a few edits.

Equal lines are one line with many places. For the rest, a segment-partition join: a line is cut into
``edits`` + 1 segments, so that a line within ``edits`` edits of it holds one of them unchanged, near
where it was. Every line is indexed by its segments together with its length, and probes the indexes of
its own and of the ``edits`` next smaller lengths with the substrings that a match allows. Candidates
are verified by the banded bit-parallel edit distance, after tests that need no text: an edit changes
whether something stands an odd number of times in a line for at most two characters and four pairs of
neighbouring characters. Lines linked by such pairs form a class, and all
but the first place of a class, by document id, text hash and line number, are taken out.

Lines shorter than ``LEAST`` characters are compared by equality alone, as two edits would make most of
them alike; blank lines are never taken out. Null texts stay null and empty ones empty.
A document that loses all its lines has an empty text. Rows that repeat an id and a text are treated
alike; rows of one id with different texts are told apart by a hash of the text. Null ids come first.
Texts of any length are handled whole, an empty table gives no rows. Other columns are kept; those
named ``n_lines`` and ``n_dropped`` are replaced.

Texts are not exchanged. The documents are read twice, and each task of the second reading takes up the
numbers of dropped lines that were stored for its partition. So the documents must come in the same
partitions both times, as tables of files do; where they do not, an error says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.graph import components
from auditlake.llm.shared import shared_folder, stored
from auditlake.llm.tokens import HASHER, code_points, mix

# Edits between lines of a class, characters of the lines that are compared by edits.
EDITS, LEAST = 2, 20
# Rows sent to every task at most (some 16 MB); more are joined by a shuffle.
SENT = 400_000
# Pairs put out at once; rows of a key, of each role, that are compared in one task.
PAIRS, RUN = 1 << 16, 8192


# --- edit distance --------------------------------------------------------------------


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``; bit-parallel over the band around the diagonal.

    Bit i of a vector stands for the cell ``edits`` - i below the diagonal; in each step the band moves
    down by one, which shifts the vectors.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    a, b = a[head:], b[head:]
    least -= head
    tail = next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= edits
    # Column j of the band holds rows j - edits to j + edits of the table, its row r in bit r - (j - edits).
    width = 2 * edits + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + 1)
    # Vertical differences of column 0, for rows 1 to edits; above row 0 they are of no effect.
    up, down = full & ~((1 << (edits + 1)) - 1), 0
    score = 0  # at the diagonal
    for j, c in enumerate(b, start=1):
        shift = j - edits
        equal = where.get(c, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & full
        # The band moved down: the vertical difference of its new last row is taken as +1.
        up, down = up >> 1 | 1 << (width - 1), down >> 1
        across = (((equal & up) + up) ^ up | equal | down) & full
        plus, minus = down | ~(across | up) & full, across & up
        # Cells above row 0 do not exist: row 0 grows by one with each column.
        if j <= edits:
            edge = edits - j  # bit of row 0
            below = full & ~((1 << (edge + 1)) - 1)
            up2, down2 = up & below, down & below
            across = (((equal & below & up2) + up2) ^ up2 | equal & below | down2) & full & below
            plus = (down2 | ~(across | up2) & full) & below | 1 << edge
            minus = across & up2
            up, down = up2, down2
        score += 0 if across >> edits & 1 else 1
        if score > 2 * edits:
            return False
        plus1, minus1 = (plus << 1) & full, (minus << 1) & full
        if j > edits:
            plus1 |= 1  # nothing is known above the band; the greatest value keeps the band exact
        up, down = (minus1 | ~(across | plus1)) & full, plus1 & across
        if j <= edits:
            up, down = up & below, down & below
    # From the diagonal's last cell, row len(b), up to row len(a).
    for r in range(len(b), len(a), -1):
        bit = 1 << (r - (len(b) - edits))
        score += (1 if down & bit else 0) - (1 if up & bit else 0)
    return score <= edits


# --- segments -------------------------------------------------------------------------


def _segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of lines of some lengths; the last segments are the longer ones."""
    size = length // (edits + 1)
    long = length - size * (edits + 1)  # so many segments are longer by one
    extra = np.maximum(0, i - (edits + 1 - long))
    return i * size + extra, size + (i >= edits + 1 - long)


def segment_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, line and role (1: index, 0: probe) of every segment and of every substring to look up.

    A line's own segments are also looked up among lines of its length, where they stand: index rows probe too.
    """
    points, starts = code_points(lines)
    sums = HASHER.sums(points)
    length = np.diff(starts)
    begin = starts[:-1]
    every = np.arange(len(lines))
    keys, owners, roles = [], [], []

    def add(at: np.ndarray, size: np.ndarray, indexed: np.ndarray, i: int, valid: np.ndarray, role: int) -> None:
        at, size, indexed = at[valid], size[valid], indexed[valid]
        place = (begin + 0)[valid] + at
        hashed = HASHER.of(sums, place, place + size)
        keys.append(mix(hashed ^ mix((indexed * (edits + 1) + i).astype(np.uint64))))
        owners.append(every[valid])
        roles.append(np.full(len(at), role, np.int8))

    for i in range(edits + 1):
        start, size = _segment(length, i, edits)
        add(start, size, length, i, np.ones(len(lines), bool), 1)
        for shorter in range(edits + 1):
            # A line shorter by ``shorter`` is indexed; its segment i may have moved by as much as the
            # edits before it allow, and as those after it allow.
            start, size = _segment(length - shorter, i, edits)
            left = max(-i, shorter - (edits - i))
            right = min(i, shorter + (edits - i))
            for move in range(left, right + 1):
                if not shorter and not move:
                    continue
                at = start + move
                valid = (length - shorter > edits) & (at >= 0) & (at + size <= length)
                add(at, size, length - shorter, i, valid, 0)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(roles)


# Bits for the parity of how often a line's characters stand in it.
PARITY = 31


def parities(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each line, none of them empty, the parities of the counts of its characters, and of its
    pairs of neighbouring characters, by bucket."""
    points, starts = code_points(lines)
    codes = points.astype(np.uint64)
    one = np.left_shift(np.int64(1), (mix(codes) % np.uint64(PARITY)).astype(np.int64))
    two = np.zeros(len(codes), np.uint64)
    two[:-1] = np.left_shift(np.uint64(1), mix(codes[:-1] << np.uint64(32) | codes[1:]) % np.uint64(64))
    two[starts[1:] - 1] = 0  # the last character of a line has no neighbour in it
    return np.bitwise_xor.reduceat(one, starts[:-1]), np.bitwise_xor.reduceat(two, starts[:-1]).view(np.int64)


def _keyed(edits: int):
    """Rows of keys for lines ``(k1, k2, line)``, each distinct line of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            _, once = np.unique(k1, return_index=True)
            lines = batch.column("line").take(pa.array(once)).to_pylist()
            keys, owners, roles = segment_keys(lines, edits)
            own = once[owners]
            # From high to low: the line's second hash, the parities, the role.
            one, two = parities(lines)
            tag = k2[own].astype(np.int64) << 32 | one[owners] << 1 | roles
            columns = (keys.view(np.int64), k1[own], tag, two[owners])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "k1", "tag", "two"])

    return run


_PAIRS = "a1 bigint, a2 bigint, b1 bigint, b2 bigint, hot boolean"


def _pairs(edits: int, limit: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different lines that share a key, one as indexed and the other as probing it.

    Batches come in the order of keys; a run of equal keys is kept as four numbers per line. Only pairs
    whose parities differ as little as the edits allow are put out. The rows of a key with more than
    ``limit`` are not compared but put out as they came, marked ``hot``.
    """

    def put(columns: np.ndarray, hot: bool) -> pa.RecordBatch:
        arrays = [pa.array(c) for c in np.ascontiguousarray(columns.T)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(columns), hot))], names=["a1", "a2", "b1", "b2", "hot"])

    def met(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        index, probe = rows[rows[:, 1] & 1 == 1], rows
        if not len(index):
            return
        at_once = max(1, PAIRS // len(probe))
        for i in range(0, len(index), at_once):
            part = index[i : i + at_once]
            differ = np.bitwise_count((part[:, None, 1] ^ probe[None, :, 1]) >> 1 & ((1 << PARITY) - 1))
            pairs = np.bitwise_count((part[:, None, 2] ^ probe[None, :, 2]).view(np.uint64))
            i_at, p_at = np.nonzero((differ <= 2 * edits) & (pairs <= 4 * edits))
            a, b = part[i_at, :2], probe[p_at, :2]
            a[:, 1] >>= 32
            b[:, 1] >>= 32
            other = (a != b).any(axis=1)
            a, b = a[other], b[other]
            swap = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
            a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            found = np.unique(np.hstack([a, b]), axis=0)
            if len(found):
                yield put(found, False)

    def handled(key: int, run: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
        if known or limit is not None and len(run) > limit:
            yield put(np.hstack([np.full((len(run), 1), key), run]), True)
        else:
            yield from met(run)

    def distinct(*columns: np.ndarray) -> np.ndarray:
        return np.unique(np.stack(columns, axis=1), axis=0)

    hot = None  # the key whose rows are being put out
    key = k1 = tag = two = np.zeros(0, np.int64)
    for batch in batches:
        fresh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "k1", "tag", "two"))
        key, k1, tag, two = (np.concatenate(x) for x in zip((key, k1, tag, two), fresh, strict=True))
        cuts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        sizes = np.diff(np.append(cuts, len(key)))
        for i in np.flatnonzero(sizes[:-1] > 1):
            run = slice(cuts[i], cuts[i] + sizes[i])
            known = key[cuts[i]] == hot
            if known or (tag[run] & 1).any() and (k1[run] != k1[cuts[i]]).any():
                yield from handled(int(key[cuts[i]]), distinct(k1[run], tag[run], two[run]), known)
        if len(sizes) > 1 and sizes[0] == 1 and key[0] == hot:
            yield put(np.array([[key[0], k1[0], tag[0], two[0]]]), True)
        last = cuts[-1] if len(cuts) else 0
        key, k1, tag, two = key[last:], k1[last:], tag[last:], two[last:]
        if len(key) and (key[0] == hot or limit is not None and len(key) > limit):
            # Equal rows, of a line that stands in many batches, are kept once.
            kept = distinct(k1, tag, two)
            if key[0] == hot or len(kept) > limit:
                hot = int(key[0])
                yield put(np.hstack([np.full((len(kept), 1), hot), kept]), True)
                kept = kept[:0]
            key, (k1, tag, two) = key[: len(kept)], kept.T
    if len(key) > 1:
        yield from handled(int(key[0]), distinct(k1, tag, two), False)


def _dealt(hot: DataFrame, run: int) -> DataFrame:
    """Rows of hot keys under keys of their own for each block of index rows and block of probe rows.

    Each index row meets each probe row of its key once, in blocks of about ``run`` rows; index rows
    are probe rows as well.
    """
    index = F.col("tag") % 2 != 0
    hot = hot.union(hot.filter(index).withColumn("tag", F.col("tag").bitwiseAND(F.lit(-2).cast("bigint")))).distinct()
    blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.sum(of.cast("bigint")) / run)).cast("int")
    sized = hot.groupBy("key").agg(blocks(index).alias("ni"), blocks(~index).alias("np"))
    own = F.pmod(F.xxhash64("k1", "tag"), F.when(index, F.col("ni")).otherwise(F.col("np"))).cast("int")
    across = F.sequence(F.lit(0), F.when(index, F.col("np")).otherwise(F.col("ni")) - 1)
    rows = hot.join(sized, "key").withColumn("own", own).withColumn("other", F.explode(across))
    cell = F.xxhash64("key", F.when(index, F.col("own")).otherwise(F.col("other")), F.when(index, F.col("other")).otherwise(F.col("own")))
    return rows.select(cell.alias("key"), "k1", "tag", "two")


def _candidate_pairs(keyed: DataFrame, edits: int, run: int) -> DataFrame:
    """Distinct pairs of lines that share a key."""
    ordered = lambda rows: rows.repartition("key").sortWithinPartitions("key")
    found = stored(ordered(keyed).mapInArrow(partial(_pairs, edits, 2 * run), _PAIRS), "line-keys")
    pairs = found.filter("NOT hot").drop("hot")
    if found.filter("hot").limit(1).count():
        hot = found.filter("hot").select(F.col("a1").alias("key"), F.col("a2").alias("k1"), F.col("b1").alias("tag"), F.col("b2").alias("two"))
        cells = _dealt(stored(hot.distinct(), "hot-keys"), run)
        pairs = pairs.unionByName(ordered(cells).mapInArrow(partial(_pairs, edits, None), _PAIRS).drop("hot"))
    return stored(pairs.distinct(), "line-pairs")


def _bounded(rows: DataFrame) -> DataFrame:
    """A stored table of numbers, marked to be sent to every task if it has few rows."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _near(lines: DataFrame, edits: int) -> DataFrame:
    """``(k1, k2, c1, c2)``: for each line with a near one the line that stands for its class."""
    keyed = lines.select("k1", "k2", "line").mapInArrow(_keyed(edits), "key bigint, k1 bigint, tag bigint, two bigint")
    pairs = _candidate_pairs(keyed, edits, RUN)
    held = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).union(pairs.select("b1", "b2")).distinct()
    wanted = stored(held, "line-candidates")
    texts = lines.join(_bounded(wanted), ["k1", "k2"]).select("k1", "k2", "line").dropDuplicates(["k1", "k2"])
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "line-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([within(x, y, edits) for x, y in sides], pa.bool_()))

    left = texts.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("node").alias("a"), F.col("line").alias("la"))
    right = texts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("node").alias("b"), F.col("line").alias("lb"))
    both = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a", "b", "la", "lb")
    roots = components(both.mapInArrow(verify, "a bigint, b bigint"))
    names = texts.select("node", "k1", "k2")
    heads = names.select(F.col("node").alias("root"), F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    return stored(roots.join(names, "node").join(heads, "root").select("k1", "k2", "c1", "c2"), "line-classes")


def repeated_lines(documents: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``(part, id, version, dropped)``: the numbers, from 0, of the lines to take out of each document of a partition."""
    rows = documents.filter(F.col(text).isNotNull()).select(
        F.spark_partition_id().alias("part"), F.col(id).alias("id"), F.xxhash64(text).alias("version"),
        F.posexplode(F.split(text, "\n")).alias("no", "line"),
    )
    keyed = rows.filter(F.col("line").rlike(r"\S")).withColumns({"k1": F.xxhash64("line"), "k2": F.hash("line").cast("bigint")})
    near = _near(keyed.filter(F.length("line") >= least), edits)
    places = stored(keyed.select("part", "id", "version", "no", "k1", "k2"), "line-places")
    classed = places.join(_bounded(near), ["k1", "k2"], "left").select(
        "part", "id", "version", "no", F.coalesce("c1", "k1").alias("c1"), F.coalesce("c2", "k2").alias("c2")
    )
    often = classed.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = stored(classed.join(often, ["c1", "c2"]), "line-repeats")
    first = again.groupBy("c1", "c2").agg(F.min(F.struct("id", "version", "no")).alias("first"))
    later = again.join(first, ["c1", "c2"]).filter(~F.struct("id", "version", "no").eqNullSafe(F.col("first")))
    return later.groupBy("part", "id", "version").agg(F.collect_set("no").alias("dropped"))


def _numbers(folder: str):
    """A column function from id and version to the stored line numbers, for the rows of one partition."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict[tuple, list[int]] = {}
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        here = f"{root}/part={TaskContext.get().partitionId()}"
        if files.get_file_info(here).type == pyarrow.fs.FileType.Directory:
            for row in pq.read_table(here, filesystem=files, partitioning=None).to_pylist():
                held[row["id"], row["version"]] = row["dropped"]
        left = set(held)
        for ids, versions in batches:
            keys = list(zip(ids.to_pylist(), versions.to_pylist(), strict=True))
            left.difference_update(keys)
            yield pa.array([held.get(key) for key in keys], pa.list_(pa.int32()))
        if left:
            raise RuntimeError("documents come in other partitions than when their lines were read; store them first")

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # The optimizer may not move it to another stage, nor work it out twice.
    return F.arrow_udf(run, T.ArrayType(T.IntegerType())).asNondeterministic()


def _rebuilt(documents: DataFrame, dropped: DataFrame, id: str, text: str) -> tuple[DataFrame, Column]:
    """Documents with ``_dropped``, the numbers of the lines to take out, and the text of the lines that stay."""
    folder = f"{shared_folder(documents.sparkSession, 'dropped-lines')}/by-part"
    dropped.repartition("part").write.partitionBy("part").parquet(folder)
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("_dropped", i))
    clean = F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return documents.withColumn("_dropped", _numbers(folder)(F.col(id), F.xxhash64(text))), clean


def without_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """The documents with the repeated lines taken out of their texts."""
    marked, clean = _rebuilt(documents, repeated_lines(documents, id, text, edits, least), id, text)
    return marked.withColumn(text, clean).select(documents.columns)


def dedup_lines(documents: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """The same, with ``n_lines`` before and ``n_dropped``."""
    given = documents.drop("n_lines", "n_dropped")
    marked, clean = _rebuilt(given, repeated_lines(documents, id, text, edits, least), id, text)
    return marked.withColumns({
        "n_lines": F.when(F.col(text).isNotNull(), F.size(F.split(text, "\n"))).otherwise(0).cast("bigint"),
        "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("bigint"),
        text: clean,
    }).drop("_dropped")
