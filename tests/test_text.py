"""Regex dialect, globs, lines and sizes against plain Python."""

from __future__ import annotations

import itertools

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import targets
from pyspark.sql import functions as F

from auditlake.functions import regex, text
from auditlake.functions.regex import glob_pattern, to_java
from auditlake.model import LONG_LINE_ERROR, ScanOptions
from auditlake.operators import paths
from auditlake.operators.catalog import builtin_rules
from auditlake.sources.tables import targets_from_table
from auditlake.operators.match import find, number_lines, scan

EDGES = ["", " ", "\t", "\x0b", "\x0c", "\x85", " ", "K", "ſ", "ı", "İ",
         "é", "\r", "_", "-", "x"]
WORDS = ["sudo", "SUDO", "ſudo", "USER root", "user root", "api_Key = \"0123456789abcdef\"",
         "runAsUser: 0", "runAsUser: 01", "hostNetworK: true", "prıvileged: true",
         "privileged:\x0btrue", "privileged:\ttrue", "FROM a:latest", "EXPOSE 80", "EXPOSE 1023",
         "password = 'abcdefgh'", "paſsword: \"abcdefgh\"", "image: a:latest", "aws"]
LINES = [a + w + b for w in WORDS for a, b in itertools.product(EDGES, EDGES)]
EXTRA = (r"\bsudo\b", r"(?i)\bSUDO\B", r"[[:alpha:]]+\z", r"^\S+\s\S+$", r"(?P<n>u)ser", r"[\s\S]x",
         r"(?i)[^a-z]s", r"\Qa.b\E", r"a&&b|[&&x]", "(?i)É")


def test_java_patterns_match_what_re2_does(spark):
    patterns = sorted({r.pattern for m in ("intent", "reference") for r in builtin_rules(m)
                       if r.pattern} | set(EXTRA))
    frame = spark.createDataFrame([(i, l) for i, l in enumerate(LINES)], "i int, l string")
    tests = [F.col("l").rlike(to_java(p)).alias(f"p{k}") for k, p in enumerate(patterns)]
    rows = frame.select("i", *tests).orderBy("i").collect()
    for k, pattern in enumerate(patterns):
        expected = pc.match_substring_regex(pa.array(LINES), pattern).to_pylist()
        got = [r[k + 1] for r in rows]
        wrong = [(LINES[i], e) for i, (e, g) in enumerate(zip(expected, got)) if e != g]
        assert not wrong, (pattern, wrong[:5])


def test_anchored():
    assert regex.anchored("^a") and regex.anchored("a$") and regex.anchored(r"a\z")
    assert not regex.anchored(r"[^a]\$\b\^")


PATHS = ["src/a.go", "srcfoo/b.go", "src/t/c.min.js", "a.min.js", "node_modules/x/y.js", "t/src/a.go",
         "src", "src/go/go.go", "a/test/b.py", "test/b.py", "x.min.js/y.txt", "src/t.go/z"]
GLOBS = ["src/**", "**/*.min.js", "**/node_modules/**", "src/**/*.go", "*.go", "src/*.go", "s**.go",
         "**", "***", "**/test/**", "src/t**/*", "a?min.js", "srcfoo**", "src/**/go"]


ALL = " ".join(p for p in PATHS if p)
# What each glob of GLOBS selects in reference mode: as a glob for files, and what it adds by selecting
# a folder above a path.
SELECTED = {
    "src/**": ("src/a.go srcfoo/b.go src/t/c.min.js src src/go/go.go src/t.go/z", ""),
    "**/*.min.js": ("src/t/c.min.js a.min.js", "x.min.js/y.txt"),
    "**/node_modules/**": ("", ""),
    "src/**/*.go": ("src/a.go srcfoo/b.go src/go/go.go", "src/t.go/z"),
    "*.go": ("src/a.go srcfoo/b.go t/src/a.go src/go/go.go", "src/t.go/z"),
    "src/*.go": ("", ""),
    "s**.go": ("", ""),
    "**": (ALL, ""),
    "***": (ALL, ""),
    "**/test/**": ("", ""),
    "src/t**/*": ("src/t/c.min.js src/t.go/z", ""),
    "a?min.js": ("a.min.js", ""),
    "srcfoo**": ("srcfoo/b.go", ""),
    "src/**/go": ("", "src/go/go.go"),
}


@pytest.mark.parametrize("ancestors", [True, False])
def test_reference_globs(spark, ancestors):
    frame = spark.createDataFrame([(p,) for p in PATHS], "p string")
    assert list(SELECTED) == GLOBS
    for glob, (files, more) in SELECTED.items():
        pattern = glob_pattern(glob, "reference", ancestors)
        test = F.col("p").rlike(pattern) if pattern else F.lit(False)
        got = {r[0] for r in frame.filter(test).collect()}
        assert got == set((files + " " + (more if ancestors else "")).split()), glob


def test_intent_globs(spark):
    frame = spark.createDataFrame([(p,) for p in PATHS], "p string")
    expected = {
        "src/**": {"src/a.go", "src/t/c.min.js", "src/go/go.go", "src/t.go/z"},
        "**/*.min.js": {"src/t/c.min.js", "a.min.js", "x.min.js/y.txt"},
        "**/node_modules/**": {"node_modules/x/y.js"},
        "**/test/**": {"a/test/b.py", "test/b.py"},
        "*.go": {"src/a.go", "srcfoo/b.go", "t/src/a.go", "src/go/go.go", "src/t.go/z"},
        "src/*.go": {"src/a.go", "src/t.go/z"},
        "[ab].??": {"src/a.go", "srcfoo/b.go", "t/src/a.go", "a/test/b.py", "test/b.py"},
        "[": set(), "a[": set(), "\\": set(), "[]a]": set(),
    }
    for glob, selected in expected.items():
        got = {r[0] for r in frame.filter(paths.excluded_by_glob(F.col("p"), [glob])).collect()}
        assert got == selected, glob


def go_lines(content: str) -> list[str]:
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [line.removesuffix("\r") for line in lines]


def test_lines_against_plain_python(spark):
    pieces = ["", "a", "\n", "\r", "\r\n", "b "]
    contents = sorted({"".join(p) for n in (1, 2, 3, 4) for p in itertools.product(pieces, repeat=n)})
    rows = number_lines(targets(spark, [(str(i), c) for i, c in enumerate(contents)])).collect()
    got = {}
    for r in rows:
        got.setdefault(r.path, {})[r.line_no] = r.line
    for i, content in enumerate(contents):
        expected = dict(enumerate(go_lines(content), start=1)) if content else {}
        assert got.get(str(i), {}) == expected, repr(content)


def test_bad_bytes_are_replaced(spark):
    frame = spark.createDataFrame([(bytearray(b"\xff\x41"),)], "b binary")
    assert frame.select(text.decode(F.col("b"))).first()[0] == "�A"


@pytest.mark.parametrize("n, failed", [(65535, False), (65536, True)])
def test_long_lines_are_an_error_for_classified_targets(spark, n, failed):
    key = "AK" + "IA" + "B" * 16
    rows = [("Dockerfile", f"USER root\n{'x' * n}\n{key}\n"), ("a.txt", f"{'x' * n}\n{key}\n")]
    results = {r.path: r for r in scan(targets(spark, rows)).collect()}
    assert results["a.txt"].error is None and len(results["a.txt"].findings) == 1
    assert results["Dockerfile"].error == (LONG_LINE_ERROR if failed else None)
    every = {"SEC001", "DOCKER001", "DOCKER009", "DOCKER012"}
    assert {f.rule_id for f in results["Dockerfile"].findings} == every
    kept = {r.path: r for r in scan(targets(spark, rows), ScanOptions(mode="reference")).collect()}
    rules = {f.rule_id for f in kept["Dockerfile"].findings}
    assert rules == ({"SEC001"} if failed else every)
    free = scan(targets(spark, rows), ScanOptions(max_line_bytes=None)).collect()
    assert all(r.error is None for r in free)


def test_long_lines_are_measured_as_given(spark):
    """Bytes that are no text become three each when repaired; they count as one."""
    rows = spark.createDataFrame([(1, b"USER root\n" + b"\xe9" * 30_000), (2, b"\xe9" * 65_536)], "id int, body binary")
    made = targets_from_table(rows, "concat('Dockerfile.', id)", "body")
    got = {r.path: r for r in scan(made).collect()}
    assert got["Dockerfile.1"].error is None and "DOCKER001" in {f.rule_id for f in got["Dockerfile.1"].findings}
    assert got["Dockerfile.2"].error == LONG_LINE_ERROR


@pytest.mark.parametrize("given, plain", [
    ("&quot;&#34;&#x22;&#034;&#X0022;", '"""""'), ("&apos;&#39;", "''"), ("&lt;&gt;", "<>"), ("&amp;quot;", "&quot;"),
    ("&#38;#34;", "&#34;"), ("&#x1F600;&#233;", "😀é"), ("&#0;&#xD800;&#99999999;", "&#0;&#xD800;&#99999999;"),
    ("a&#", "a&#"), ("&#112;wd", "pwd"), ("a & b", "a & b"), ("$&#36;\\&#92;", "$$\\\\"),
])
def test_character_references(spark, given, plain):
    frame = spark.createDataFrame([(given,)], "t string")
    assert frame.select(text.unescape_html(F.col("t"))).first()[0] == plain


def test_human_size(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1536: "1.5 KB",
             1048575: "1024.0 KB", 1048576: "1.0 MB", 10485760: "10.0 MB", 1 << 40: "1.0 TB"}
    frame = spark.createDataFrame([(k,) for k in cases], "n bigint")
    got = frame.select("n", F.expr(text.human_size_sql("n"))).collect()
    assert {r[0]: r[1] for r in got} == cases


@pytest.mark.parametrize("pattern", [
    r"(a|b)+", r"(?P<x>a)(?:b)(?i:C)", r"[(\]]+(\()", r"[]()]x(y)", r"[^](a]", r"\Q(a)\E(b)", r"[[:alpha:](]+(é)", r"(?i)(s)k", r"\((a)\)",
])
def test_patterns_without_groups(pattern):
    import re

    texts = ["ab", "(a)b", "(]((", "]y xy", "(a", "(b)", "aé((é", "SK sk", "(a)", "", "x)xy", "]x(y"]
    plain = regex.without_groups(pattern)
    assert "(?P<x>" not in plain
    array = pa.array(texts)
    assert pc.match_substring_regex(array, plain).to_pylist() == pc.match_substring_regex(array, pattern).to_pylist()
    # A named group around it is all that captures.
    pc.extract_regex(array, f"(?P<m>{plain})")


def test_all_matches_in_place():
    from auditlake.functions.gate import all_matches, lines_of

    assert list(all_matches("aé12 é3 x", r"(?P<m>[0-9]+)")) == ["12", "3"]
    assert list(all_matches("ab ab cab", r"(?P<m>\bab\b)")) == ["ab", "ab"]
    assert list(all_matches("éab ab", r"(?P<m>\Bb)")) == ["b", "b"]
    assert list(all_matches("aaa", r"(?P<m>^a)")) == ["a"]
    assert list(all_matches("ñaa", r"(?P<m>x*)")) == ["", "", "", ""]
    assert list(all_matches("aXbxc", r"(?P<m>(?i)x)")) == ["X", "x"]
    for text in ("", "\n", "a", "a\n", "a\r\n", "\r", "a\n\n", "a\r\nb\rc\n"):
        parts = text.removesuffix("\n").removesuffix("\r").replace("\r\n", "\n").split("\n")
        assert lines_of(text) == parts


def test_hostile_lines_take_time_in_proportion(spark):
    """A backtracking engine takes the square of the length of such a line."""
    import time

    token = "gh" + "p_" + "a" * 36
    seconds = []
    for size in (1_000_000, 4_000_000):
        line = "https://hooks." + "slack.com/services/T" + "A" * size + " postgres" + "://" + "a:" * (size // 2) + " " + token
        frame = spark.createDataFrame([("a.txt", "FILE", line)], "path string, type string, content string")
        begin = time.perf_counter()
        found = [(r.rule_id, r.start_line) for r in find(frame, ScanOptions(scanners=("secrets",))).collect()]
        seconds.append(time.perf_counter() - begin)
        assert found == [("SEC003", 1)]
    assert seconds[1] < 10 * max(seconds[0], 1)


@pytest.mark.parametrize("pattern, expected", [
    (r"abc[0-9]+defg", {"defg"}), (r"(abc|defg)x", {"abc", "defg"}), (r"(abc|d)x", None), (r"(?i)abcd", None), (r"a?bcd", {"bcd"}),
    (r"(abcd)?x", None), (r"(abcd){2,}", {"abcd"}), (r"x(?i:abc)defg", {"defg"}), (r"x(?:(?i)abc)defg", None), (r"\Qabc\E", None), (r"\p{L}abc", None), (r"a\.bc", {"a.bc"}), (r"", None),
])
def test_literals_of_patterns(pattern, expected):
    assert regex.literals(pattern) == (expected and frozenset(expected))


def test_many_rules_find_what_few_find(spark):
    from auditlake.operators.catalog import custom_rule

    rules = [custom_rule(f"R{i}", "r", "LOW", p) for i, p in enumerate(
        [rf"word{i:02d}[a-c]+" for i in range(60)] + [r"(?i)MiX\d", r"[xyz]{5}", r"\bend\b|stop[0-9]"]
    )]
    rows = [(f"f{i}", f"a word{i:02d}abc word{i + 1:02d}\nxyzzy mix{i % 10}\nend stop1 {'x' * (i % 7)}") for i in range(70)] + [("none", None), ("empty", "")]

    def run(some):
        frame = find(targets(spark, rows), ScanOptions(scanners=("misconfig",), custom_rules=tuple(some)))
        return {(r.file_path, r.rule_id, r.start_line, r.match) for r in frame.collect()}

    assert run(rules) == run(rules[:32]) | run(rules[32:]) and len(run(rules)) > 200


def test_matches_of_many_lines_equal_those_of_each():
    import numpy as np
    import pyarrow as pa

    from auditlake.functions.gate import matches_of

    lines = ["aé12 é3 x", "", "none", "7", "é", "1é22é333"]
    for pattern in (r"(?P<m>[0-9]+)", r"(?P<m>\b[0-9])", r"(?P<m>x*)"):
        held = pa.array(["cut off", *lines])[1:]
        each = [matches_of(pa.array([line]), np.zeros(1, np.int64), pattern)[0] for line in lines]
        assert matches_of(held, np.arange(len(lines)), pattern) == each
        assert matches_of(held, np.array([0, 3, 5]), pattern) == [each[i] for i in (0, 3, 5)]
    assert matches_of(held, np.array([0, 5]), r"(?P<m>[0-9]+)") == [["12", "3"], ["1", "22", "333"]]


def test_calls_of_the_gate_do_not_grow_with_texts(spark, monkeypatch):
    """Where every text holds a secret, patterns are compiled for a batch and not for each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from auditlake.functions import gate

    calls = []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(pc, name)

    monkeypatch.setattr(gate, "pc", Counted())
    pattern = r"id-[0-9]+"
    may_fire = gate.arrow_gate([(0, "", pattern)], 0, 1, [gate.Located(0, pattern, True, True)]).func
    made = {}
    for n in (3, 300):
        calls.clear()
        texts = pa.array([f"first\nid-{i} id-{i + 1}\r\n" if i % 3 else None for i in range(n)])
        rows = may_fire(texts, pa.nulls(n, pa.string())).to_pylist()
        hit = [{"rule": 0, "line_no": 2, "matches": ["id-1", "id-2"], "line": "id-1 id-2"}]
        assert rows[0]["found"] == [] and rows[1] == {"bits": [1], "found": hit}
        assert rows[-1]["found"][0]["matches"] == [f"id-{n - 1}", f"id-{n}"]
        made[n] = len(calls)
    assert made[3] == made[300]
