"""Texts cut into the pieces that byte pair merges never cross, each distinct piece once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

from auditlake.llm.tokens import LETTER, NUMBER, OTHER, SPACE, classes, code_points, runs

# The endings that an apostrophe takes along.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

Cuts = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _take_endings(first, points, starts, begin, kind, fold: bool) -> None:
    """An apostrophe that stands alone before letters takes a known ending along."""
    marks = np.flatnonzero(points == ord("'"))
    at = np.searchsorted(begin, marks)
    inside = at < len(begin) - 1
    marks, at = marks[inside], at[inside]
    alone = (begin[at] == marks) & first[marks] & (begin[at + 1] == marks + 1) & (kind[at + 1] == LETTER)
    for i in at[alone]:
        b = begin[i + 1]
        e = begin[i + 2] if i + 2 < len(begin) else len(points)
        if starts[np.searchsorted(starts, b)] == b:
            continue
        ahead = "".join(map(chr, points[b : min(e, b + 2)]))
        ahead = ahead.lower() if fold else ahead
        ending = next((x for x in ENDINGS if ahead.startswith(x)), None)
        if ending:
            first[b] = False
            if b + len(ending) < e:
                first[b + len(ending)] = True


def byte_level_cuts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start: words with the one blank before them, and white space."""
    begin, kind = runs(points, starts)
    first = np.zeros(len(points), bool)
    first[begin] = True
    space = kind == SPACE
    at = begin[1:][space[:-1] & ~space[1:]]
    at = at[np.isin(at, starts[1:-1], invert=True, kind="table")] if len(starts) > 2 else at
    first[at - 1] = True
    first[at[points[at - 1] == ord(" ")]] = False
    _take_endings(first, points, starts, begin, kind, fold=False)
    return np.flatnonzero(first)


def word_cuts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start: runs of letters, single numbers, runs of other signs, and white space, which
    this kind of tokenizer drops."""
    begin, kind = runs(points, starts)
    first = np.zeros(len(points), bool)
    first[begin] = True
    numbers = np.flatnonzero(kind == NUMBER)
    for i in numbers[np.append(begin[1:], len(points))[numbers] - begin[numbers] > 1]:
        first[begin[i] : begin[i + 1] if i + 1 < len(begin) else len(points)] = True
    first[starts[:-1][starts[:-1] < len(points)]] = True
    _take_endings(first, points, starts, begin, kind, fold=True)
    return np.flatnonzero(first)


@cache
def folds_oddly() -> np.ndarray:
    """Code points whose lower case is longer or of another class."""
    kind = classes()
    odd = np.zeros(0x110000, bool)
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        low = chr(c).lower()
        odd[c] = len(low) != 1 or (ord(low) != c and kind[ord(low)] != kind[c])
    return odd


@cache
def _lower() -> np.ndarray:
    """The lower case of every code point that has a single one of its class, else itself."""
    table = np.arange(0x110000, dtype="<u4")
    for c in np.flatnonzero(~folds_oddly()).tolist():
        if not 0xD800 <= c < 0xE000:
            table[c] = ord(chr(c).lower())
    return table


def lowered(texts: list[str]) -> list[str]:
    """The texts in lower case, one code point at a time."""
    points, starts = code_points(texts)
    whole = _lower()[points].tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[b:e] for b, e in zip(starts.tolist(), starts[1:].tolist(), strict=False)]


def pieces(texts: list[str], cuts: Cuts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the pieces of all texts as numbers of these, and where each text's pieces start."""
    points, starts = code_points(texts)
    if not len(points):
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    begin = cuts(points, starts)
    # A code point of up to 7, 11, 16 or more bits takes that many bytes in UTF-8.
    width = np.ones(len(points), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    ends = np.zeros(len(points) + 1, np.int32)
    np.cumsum(width, dtype=np.int32, out=ends[1:])
    offsets = np.append(ends[begin], ends[-1])
    data = pa.py_buffer("".join(texts).encode())
    every = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), data).dictionary_encode()
    # By way of numpy the strings are made without an Arrow scalar for each.
    distinct = every.dictionary.to_numpy(zero_copy_only=False).tolist()
    return distinct, every.indices.to_numpy(), np.searchsorted(begin, starts)


def spread(numbers: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts, of items of ``width`` bytes, in the order of ``numbers``, and where each ends up."""
    kind = np.dtype(f"<u{width}")
    flat = np.frombuffer(b"".join(parts), kind)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    first = np.cumsum(lengths) - lengths
    sizes = lengths[numbers]
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    index = np.repeat(first[numbers] - ends[:-1], sizes) + np.arange(ends[-1])
    return flat[index], ends
