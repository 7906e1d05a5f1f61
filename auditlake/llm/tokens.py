"""Texts as arrays: code points, runs of one character class, hashes of any substring.

All functions work on the texts of one Arrow batch at a time, in slices of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Code points of the texts handled at once; a longer text is a slice of its own.
SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    found = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for code, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found[[ord(c) for c in regex.findall(pattern, every)]] = code
    return found


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of up to about ``SLICE`` code points together, with the first one's index."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text starts (one entry more than texts)."""
    starts = np.fromiter(accumulate(map(len, texts), initial=0), np.int64, len(texts) + 1)
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), starts


def runs(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and class of each run of one character class within one text."""
    kind = classes()[points]
    first = np.empty(len(points), bool)
    if len(points):
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first[starts[:-1][starts[:-1] < len(points)]] = True
    begin = np.flatnonzero(first)
    return begin, kind[begin]


class Hasher:
    """Polynomial hashes of substrings, from running sums over the code points."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.power) <= size:
            for name, base in (("power", _BASE), ("inverse", _BASE_INVERSE)):
                steps = np.full(2 * size + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, points: np.ndarray) -> np.ndarray:
        self._grow(len(points))
        found = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.power[: len(points)], out=found[1:])
        return found

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each substring; equal substrings have equal hashes wherever they stand."""
        return mix((sums[end] - sums[begin]) * self.inverse[begin])


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


HASHER = Hasher()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts (runs of letters or of numbers, in lower case), and where each
    text's words start."""
    points, starts = code_points([text.lower() for text in texts])
    begin, kind = runs(points, starts)
    end = np.append(begin[1:], len(points))
    word = (kind == LETTER) | (kind == NUMBER)
    begin, end = begin[word], end[word]
    return HASHER.of(HASHER.sums(points), begin, end), np.searchsorted(begin, starts)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a text, and where each text's shingles start.

    A text of fewer words, but at least one, has one shingle: all of them.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths == 0, 0, np.maximum(lengths - width + 1, 1))
    starts = np.concatenate(([0], np.cumsum(counts)))
    first = np.repeat(offsets[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    left = np.repeat(offsets[1:], counts) - first
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    total = np.zeros(len(first), np.uint64)
    for i in range(width):
        part = padded[first + i] if i == 0 else np.where(left > i, padded[first + i], np.uint64(0))
        total = mix(total * _BASE + part + np.uint64(i + 1))
    return total, starts
