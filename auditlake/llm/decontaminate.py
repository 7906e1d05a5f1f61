"""Benchmark passages in texts, found by greedy string tiling.

Words (runs of letters or numbers, in lower case) are compared by their 64-bit hashes. Any ``width``
words in a row that a text shares with a passage are a seed; what the seeds of a pair cover bounds what
tiles can cover. Pairs whose bound reaches the threshold are tiled: the longest matches that overlap no
tile yet are marked again and again, found by running Karp-Rabin with a falling search length, down to
``width`` words. The share of the passage's words under tiles is its coverage, whatever their order in
the text.

The passages travel to the tasks in blocks of at most ``BLOCK`` words, with a pass over the texts for
each block, so no block grows with the benchmark. Passages of fewer than ``width`` words, null and
empty ones take no part, nor do those without an id. Null and empty texts have no leaks. Repeated texts
are found each, a repeated passage counts once per row. Texts are read whole. Empty tables give no
leaks. Other columns are kept; one named ``leaks`` is replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.tokens import shingles, slices, words

WIDTH, COVERAGE = 5, 0.8
# Words of passages sent to the tasks at once: 16 MB of hashes.
BLOCK = 1 << 21
LEAKS = "array<struct<item_id: bigint, coverage: double, tiles: int>>"


def tile(passage: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(start in passage, start in text, length)`` of at least ``least`` words, without overlap."""
    free_p, free_t = [True] * len(passage), [True] * len(text)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(passage), len(text)))
    while True:
        found = _matches(passage, text, free_p, free_t, length)
        longest = max((n for *_, n in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        for p, t, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if all(free_p[p : p + n]) and all(free_t[t : t + n]):
                free_p[p : p + n] = free_t[t : t + n] = [False] * n
                tiles.append((p, t, n))
        if length == least and not any(n >= least for *_, n in _matches(passage, text, free_p, free_t, least)):
            return tiles
        length = max(least, length // 2) if length > least else least


def _windows(values: list[int], free: list[bool], size: int):
    """Start and rolling Karp-Rabin hash of each window of free words."""
    top = pow(_RADIX, size - 1, _PRIME)
    rolling = run = 0
    for i, value in enumerate(values):
        if not free[i]:
            rolling = run = 0
            continue
        if run >= size:
            rolling = (rolling - values[i - size] % _PRIME * top) % _PRIME
        rolling = (rolling * _RADIX + value) % _PRIME
        run += 1
        if run >= size:
            yield i - size + 1, rolling


_PRIME, _RADIX = (1 << 61) - 1, 1_000_003


def _matches(passage, text, free_p, free_t, size: int) -> list[tuple[int, int, int]]:
    """Longest matches of free words from each pair of places where ``size`` words agree."""
    where = defaultdict(list)
    for p, hashed in _windows(passage, free_p, size):
        where[hashed].append(p)
    found, reach = [], {}
    for t, hashed in _windows(text, free_t, size):
        for p in where.get(hashed, ()):
            # A place inside a match that began earlier on the same diagonal is part of it.
            if reach.get(t - p, -1) > t:
                continue
            n = 0
            while p + n < len(passage) and t + n < len(text) and free_p[p + n] and free_t[t + n] and passage[p + n] == text[t + n]:
                n += 1
            if n >= size:
                found.append((p, t, n))
                reach[t - p] = t + n
    return found


class Passages:
    """Passages of one block, with an index from each seed to where it stands."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, width: int, coverage: float) -> None:
        self.ids, self.hashes, self.offsets, self.width, self.coverage = ids, hashes, offsets, width, coverage
        seeds, starts = shingles(hashes, offsets, width)
        item = np.repeat(np.arange(len(ids)), np.diff(starts))
        place = np.arange(len(seeds)) - starts[item]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.first = np.unique(seeds[order], return_index=True)
        self.first = np.append(self.first, len(seeds))
        self.item, self.place = item[order], place[order]

    def leaks(self, texts: list[str]) -> list[list[dict]]:
        found: list[list[dict]] = []
        for _, part in slices(texts):
            hashes, offsets = words(part)
            windows, starts = shingles(hashes, offsets, self.width)
            found += self._leaks(hashes, offsets, windows, starts)
        return found

    def _leaks(self, hashes, offsets, windows, starts) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        if not len(self.seeds) or not len(windows):
            return found
        at = np.minimum(np.searchsorted(self.seeds, windows), len(self.seeds) - 1)
        hits = np.flatnonzero(self.seeds[at] == windows)
        seed, text = at[hits], np.searchsorted(starts, hits, "right") - 1
        counts = self.first[seed + 1] - self.first[seed]
        entry = np.repeat(self.first[seed] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        text, hit = np.repeat(text, counts), np.repeat(hits - starts[text], counts)
        item, place = self.item[entry], self.place[entry]
        order = np.lexsort((place, item, text))
        text, item, place, hit = text[order], item[order], place[order], hit[order]
        cuts = [0, *(np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1), len(text)]
        for b, e in zip(cuts, cuts[1:], strict=False):
            if b == e:
                continue
            i, t = int(item[b]), int(text[b])
            size = int(self.offsets[i + 1] - self.offsets[i])
            places = np.unique(place[b:e])
            covered = np.minimum(np.diff(places, append=size), self.width).sum()
            if covered < self.coverage * size:
                continue
            passage = self.hashes[self.offsets[i] : self.offsets[i + 1]].tolist()
            tiles = tile(passage, self._near(hashes[offsets[t] : offsets[t + 1]], np.unique(hit[b:e])), self.width)
            share = sum(n for *_, n in tiles) / size
            if share >= self.coverage:
                found[t].append({"item_id": int(self.ids[i]), "coverage": share, "tiles": len(tiles)})
        return found

    def _near(self, text: np.ndarray, hits: np.ndarray) -> list[int]:
        """The words under seeds; a word that nothing equals stands for each gap between them."""
        near: list[int] = []
        end = 0
        for hit in hits.tolist():
            if hit > end and near:
                near.append(-1 - hit)
            begin = max(hit, end)
            end = hit + self.width
            near += text[begin:end].tolist()
        return near


def _blocks(benchmark: DataFrame, item: str, passage: str, width: int, coverage: float) -> list[Passages]:
    usable = benchmark.filter(F.col(item).isNotNull() & F.col(passage).isNotNull())

    def run(batches):
        for batch in batches:
            hashes, offsets = words(batch.column("text").to_pylist())
            parts = [hashes[b:e].tobytes() for b, e in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(parts, pa.binary())], names=["id", "size", "words"])

    rows = usable.select(F.col(item).cast("bigint").alias("id"), F.col(passage).alias("text"))
    hashed = rows.mapInArrow(run, "id bigint, size bigint, words binary").filter(F.col("size") >= width)
    total = hashed.agg(F.sum("size")).first()[0] or 0
    count = -(-total // BLOCK)
    found = []
    for block in range(count):
        got = hashed.filter(F.pmod(F.xxhash64("id"), F.lit(count)) == block).orderBy("id").toArrow()
        parts = [np.frombuffer(w, np.uint64) for w in got["words"].to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        found.append(Passages(got["id"].to_numpy(), np.concatenate([np.zeros(0, np.uint64), *parts]), offsets, width, coverage))
    return found


def _leaks_of(block: Passages, text: str) -> Column:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))

    @F.arrow_udf(LEAKS)
    def leaks(values: pa.Array) -> pa.Array:
        return pa.array(block.leaks([t or "" for t in values.to_pylist()]), kind)

    return leaks.asNondeterministic()(F.col(text))  # so that a filter on it does not work it out twice


def leaks(
    benchmark: DataFrame, text: str = "text", item: str = "item_id", passage: str = "text",
    width: int = WIDTH, coverage: float = COVERAGE,
) -> Column:
    """The passages of which a text holds at least the share ``coverage``."""
    found = [_leaks_of(b, text) for b in _blocks(benchmark, item, passage, width, coverage)]
    return F.concat(*found) if found else F.array().cast(LEAKS)


def with_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Add ``leaks``."""
    return documents.drop("leaks").withColumn("leaks", leaks(benchmark, text, **options))
