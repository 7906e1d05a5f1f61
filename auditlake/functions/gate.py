"""Which rules may fire somewhere in a text, told before it is split into lines.

A rule whose pattern matches nowhere in a text fires on none of its lines, so
most texts need no splitting and the others only the rules that matched. A gate
may name too many rules, never too few: what a line must satisfy is decided by
the rule itself.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.regex import literals, without_groups

# With more rules for any file than this, those that name literals are sought by one automaton.
FEW_RULES = 48
# Rule bits in one signed 64-bit word.
WORD = 62
# Bytes of texts whose lines are looked at together.
TOGETHER = 8 << 20


def bit(index: int) -> str:
    """SQL condition: the bit of a rule is set in ``may_fire``."""
    return f"(get(may_fire, {index // WORD}) & {1 << index % WORD}L) <> 0"


@dataclass(frozen=True)
class Located:
    """A rule whose lines are found beside the gate: all its matches or the line itself may be wanted."""

    index: int
    pattern: str
    matches: bool = False
    line: bool = False


@dataclass(frozen=True)
class Blanked:
    """The rule for tokens that no other rule matches: what others match is blanked out first.

    ``others`` holds pairs of a pattern and of one that keeps it from being blanked on a line, or ``None``.
    """

    index: int
    pattern: str
    others: tuple[tuple[str, str | None], ...]


FOUND = "array<struct<rule:int,line_no:int,matches:array<string>,line:string>>"
_FOUND = pa.list_(pa.struct([
    ("rule", pa.int32()), ("line_no", pa.int32()), ("matches", pa.list_(pa.string())), ("line", pa.string()),
]))
# What a pattern can tell of the text before it; RE2 has no other look behind.
_LOOKS_BACK = re.compile(r"\\[bBA]|\^|\(\?[a-zA-Z]*m")


def lines_of(content: str) -> list[str]:
    """The lines of a text, as ``functions.text.split_lines`` cuts them."""
    content = content.removesuffix("\n").removesuffix("\r")
    return content.replace("\r\n", "\n").split("\n")


def all_matches(line: str, pattern: str) -> Iterator[str]:
    """Every match of a pattern that names its result ``m``, from left to right, in linear time.

    The rest of the line is looked at in place. After the first match the sign before the rest is kept
    in sight of patterns that look back.
    """
    yield from matches_of(pa.array([line], pa.string()), np.zeros(1, np.int64), pattern)[0]


def matches_of(lines: pa.Array, rows: np.ndarray, pattern: str) -> list[list[str]]:
    """``all_matches`` of the lines that ``rows`` names in ascending order, each step over all of them at once."""
    found: list[list[str]] = [[] for _ in rows]
    if not len(rows):
        return found
    after = rf"(?s:\A.(?:.*?)){pattern}" if _LOOKS_BACK.search(pattern) else pattern
    offsets = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, 4 * lines.offset).astype(np.int64)
    held = lines.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(held, np.uint8)
    left, at, end = np.arange(len(rows)), offsets[rows], offsets[rows + 1]
    begin, tried = at, pattern
    while len(left):
        # What lies between two rests is a null, so that all of them are looked at in place.
        bounds = np.column_stack((begin, end)).reshape(-1).astype(np.int32)
        valid = np.packbits(np.arange(2 * len(left) - 1) % 2 == 0, bitorder="little")
        rests = pa.Array.from_buffers(pa.string(), 2 * len(left) - 1, [pa.py_buffer(valid), pa.py_buffer(bounds), held])
        spans = pc.extract_regex_span(rests, tried)
        hit = spans.is_valid().to_numpy(zero_copy_only=False)[::2]
        span = spans.field("m").values.to_numpy().reshape(-1, 2)[::2][hit].astype(np.int64)
        left, end = left[hit], end[hit]
        start = begin[hit] + span[:, 0]
        at = start + span[:, 1]
        for row, s, e in zip(left.tolist(), start.tolist(), at.tolist(), strict=True):
            found[row].append(data[s:e].tobytes().decode())
        empty = span[:, 1] == 0
        at = _next_sign(data, np.where(empty, at + 1, at), end, empty)
        on = at <= end
        left, at, end = left[on], at[on], end[on]
        begin, tried = at, after
        if after is not pattern:
            begin = at - 1
            while (inside := data[begin] & 0xC0 == 0x80).any():
                begin = begin - inside
    return found


def _next_sign(data: np.ndarray, at: np.ndarray, end: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The places that were ``moved`` by a byte, moved on to where a sign begins."""
    while (inside := moved & (at < end) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80) if len(data) else np.zeros(len(at), bool)).any():
        at = at + inside
    return at


def _fires(lines: pa.Array, pattern: str) -> np.ndarray:
    """The numbers of the lines that a pattern matches."""
    return np.flatnonzero(pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False))


def _blanked_tokens(lines: pa.Array, blanked: Blanked) -> list[list[str]]:
    """The tokens of each line that stand where no other rule matches."""
    rest = lines
    for pattern, unless in blanked.others:
        cleared = pc.replace_substring_regex(rest, pattern, " ")
        rest = cleared if unless is None else pc.if_else(pc.match_substring_regex(lines, unless), rest, cleared)
    # The token stands between quotes; the closing one cannot open another.
    named, found = blanked.pattern.replace("(", "(?P<m>", 1), [[] for _ in range(len(lines))]
    for i in _fires(rest, blanked.pattern).tolist():
        left = rest[i].as_py()
        while (token := next(all_matches(left, named), None)) is not None:
            found[i].append(token)
            left = left[left.index(token, 1) + len(token) + 1 :]
    return found


def _parts(content: pa.Array, rows: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of the rows, cut where the bytes of their texts fill another ``TOGETHER``."""
    if len(rows):
        sizes = pc.binary_length(content).take(pa.array(rows)).to_numpy(zero_copy_only=False)
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        yield from np.split(rows, np.flatnonzero(np.diff(before // TOGETHER)) + 1)


def _located(
    texts: Sequence[str], on: dict[int, np.ndarray], rules: dict[int, Located], blanked: Blanked | None
) -> pa.Array:
    """What ``FOUND`` holds of each text: the lines of the rules that may fire on it.

    The lines of all texts are tried together, so that a pattern is compiled once for them and not once
    for each. ``on`` tells for each rule on which texts it may fire.
    """
    cut = [lines_of(t) for t in texts]
    counts = np.array([len(c) for c in cut], np.int64)
    first = np.cumsum(counts) - counts
    text_of = np.repeat(np.arange(len(cut)), counts)
    lines = pa.array([line for c in cut for line in c], pa.string())
    rule_of, line_at, matches, shown = [], [], [], []
    for i, may in on.items():
        rows = np.flatnonzero(may[text_of])
        some = lines if len(rows) == len(lines) else lines.take(pa.array(rows))
        if blanked and i == blanked.index:
            fires = _fires(some, blanked.pattern)
            matches += _blanked_tokens(some.take(pa.array(fires)), blanked)
            shown += [None] * len(fires)
        else:
            rule = rules[i]
            fires = _fires(some, rule.pattern)
            matches += matches_of(some, fires, f"(?P<m>{without_groups(rule.pattern)})") if rule.matches else [None] * len(fires)
            shown += some.take(pa.array(fires)).to_pylist() if rule.line else [None] * len(fires)
        rule_of.append(np.full(len(fires), i))
        line_at.append(rows[fires])
    if not rule_of:
        return pa.array([[]] * len(cut), _FOUND)
    at = np.concatenate(line_at)
    # By text, and within one by rule and line.
    order = np.argsort(text_of[at], kind="stable")
    at, numbers = at[order], np.concatenate(rule_of)[order]
    taken = pa.array(order)
    hits = pa.StructArray.from_arrays(
        [
            pa.array(numbers, pa.int32()), pa.array(at - first[text_of[at]] + 1, pa.int32()),
            pa.array(matches, pa.list_(pa.string())).take(taken), pa.array(shown, pa.string()).take(taken),
        ],
        fields=list(_FOUND.value_type),
    )
    ends = np.concatenate(([0], np.cumsum(np.bincount(text_of[at], minlength=len(cut)))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits, type=_FOUND)


@cache
def _automaton(words: tuple[tuple[str, tuple[int, ...]], ...]):
    """An automaton of literals that names the rules each belongs to."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, rules in words:
        made.add_word(word, rules)
    made.make_automaton()
    return made


def _literals(rules: Sequence[tuple[int, str]]) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """Each literal with the rules that need it, or another of theirs; nothing for few rules."""
    if len(rules) <= FEW_RULES or importlib.util.find_spec("ahocorasick") is None:
        return ()
    held: dict[str, list[int]] = {}
    for i, pattern in rules:
        for word in literals(pattern) or ():
            held.setdefault(word, []).append(i)
    return tuple((word, tuple(of)) for word, of in sorted(held.items()))


def arrow_gate(
    patterns: Sequence[tuple[int, str, str]], always: int, size: int,
    located: Sequence[Located] = (), blanked: Blanked | None = None,
):
    """Bits of the rules that may fire, and the lines of some of them, from RE2 over Arrow batches.

    ``patterns`` holds rule index, kind of file (``""`` for any) and RE2 text.
    Rules for any file are first tried together in one pass over the text; only
    texts with a match are tried against each. Of many rules, those that name
    literals are tried only on texts that one automaton finds these in. Where a ``located`` rule may
    fire, its lines and matches are found here, as RE2 takes time in proportion
    to the text whatever it holds. Spark bounds each batch by
    ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    words = -(-size // WORD)
    anywhere = [(i, p) for i, kind, p in patterns if not kind]
    words_of = _literals(anywhere)
    named = {i for _, of in words_of for i in of}
    by_word = [(i, p) for i, p in anywhere if i in named]
    anywhere = [(i, p) for i, p in anywhere if i not in named]
    union = "|".join(f"(?:{p})" for _, p in anywhere)
    by_kind = {}
    for i, kind, p in patterns:
        if kind:
            by_kind.setdefault(kind, []).append((i, p))
    start = [(always >> (WORD * w)) & ((1 << WORD) - 1) for w in range(words)]
    sought = {rule.index: rule for rule in located}
    ends = (*sought, *((blanked.index,) if blanked else ()))
    wanted = np.zeros(words, np.int64)
    for i in ends:
        wanted[i // WORD] |= np.int64(1 << i % WORD)

    @F.arrow_udf(f"struct<bits:array<bigint>,found:{FOUND}>")
    def may_fire(content: pa.Array, kind: pa.Array) -> pa.Array:
        bits = np.tile(np.array(start, dtype=np.int64), (len(content), 1))

        def mark(rows: np.ndarray, rules: list) -> None:
            if len(rows) == 0:
                return
            texts = content.take(pa.array(rows))
            for i, pattern in rules:
                found = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
                bits[rows[found.astype(bool)], i // WORD] |= np.int64(1 << i % WORD)

        if anywhere:
            some = pc.fill_null(pc.match_substring_regex(content, union), False)
            mark(np.flatnonzero(some.to_numpy(zero_copy_only=False)), anywhere)
        if by_word:
            rows: dict[int, list[int]] = {}
            for row, text in enumerate(content.to_pylist()):
                for i in {i for _, of in _automaton(words_of).iter(text) for i in of} if text else ():
                    rows.setdefault(i, []).append(row)
            for i, pattern in by_word:
                mark(np.array(rows.get(i, ()), np.int64), [(i, pattern)])
        for name, rules in by_kind.items():
            of_kind = pc.fill_null(pc.equal(kind, name), False)
            mark(np.flatnonzero(of_kind.to_numpy(zero_copy_only=False)), rules)
        parts, place, done = [pa.array([[]], _FOUND)], np.zeros(len(content), np.int64), 1
        for part in _parts(content, np.flatnonzero((bits & wanted).any(axis=1))):
            on = {i: bits[part, i // WORD] >> i % WORD & 1 == 1 for i in ends}
            texts = content.take(pa.array(part)).to_pylist()
            parts.append(_located(texts, {i: may for i, may in on.items() if may.any()}, sought, blanked))
            place[part] = np.arange(done, done + len(part))
            done += len(part)
        found = pa.concat_arrays(parts).take(pa.array(place))
        offsets = pa.array(np.arange(len(content) + 1, dtype=np.int32) * words)
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(bits.reshape(-1))), found], names=["bits", "found"]
        )

    # The optimizer may not copy a filter on the bits, and with it the UDF, down.
    return may_fire.asNondeterministic()


def builtin_gate(conditions: Sequence[tuple[int, str]], always: int, size: int) -> Column:
    """The same bits from SQL conditions on ``content``, without Python workers."""
    words = []
    for w in range(-(-size // WORD)):
        terms = [f"{(always >> (WORD * w)) & ((1 << WORD) - 1)}L"]
        terms += [
            f"CASE WHEN {test} THEN {1 << i % WORD}L ELSE 0L END"
            for i, test in conditions
            if i // WORD == w
        ]
        words.append(" | ".join(terms))
    return F.expr(f"array({', '.join(words)})")
