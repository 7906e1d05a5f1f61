"""RE2 pattern text to Java pattern text, and file globs to Java patterns.

Rules state their patterns in RE2 syntax, the dialect their meaning is defined
in. Spark's ``rlike`` runs ``java.util.regex``, which reads ``$``, ``.``,
``\\s``, ``\\b`` and ``(?i)`` differently; ``to_java`` writes the same language
in Java syntax. Constructs RE2 refuses (lookaround, back references, atomic and
possessive groups) raise ``ValueError``.
"""

from __future__ import annotations

import re
from re import _parser

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError

_SPACE = r"\t\n\f\r "
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NOT_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
# Non-ASCII characters that RE2 folds onto an ASCII letter under (?i).
_FOLDS = {"k": "\u212a", "s": "\u017f"}
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z",
    "upper": "A-Z", "space": r"\t\n\x0B\f\r ", "word": r"\w", "xdigit": "0-9A-Fa-f",
    "blank": r"\t ", "punct": r"\p{Punct}", "print": r"\x20-\x7E", "graph": r"\x21-\x7E",
    "cntrl": r"\x00-\x1F\x7F", "ascii": r"\x00-\x7F",
}
_POSIX_CLASS = re.compile(r"\[:(\^?)(\w+):\]")


def check(pattern: str) -> None:
    """Raise ``ValueError`` unless RE2 accepts the pattern."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as error:
        raise ValueError(f"invalid pattern: {error}") from None


def anchored(pattern: str) -> bool:
    """Whether the pattern can tell the ends of a line from a break within a text.

    Word boundaries cannot: a line break is no word character either.
    """
    bare = re.sub(r"\\[^Az]", "", pattern)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return bool(re.search(r"[\^$]|\\[Az]", bare))


def to_java(pattern: str) -> str:
    """The same language as RE2 ``pattern``, for ``rlike`` and ``regexp_extract``.

    Flags hold to the end of their group, or inside their own one. Two things
    that RE2 knows are refused, as Java cannot say them: single bytes (``\\C``)
    and the exchange of greedy and lazy (the flag ``U``).
    """
    check(pattern)
    out: list[str] = []
    # Flags in force: those of the group that is open, and below it of those around it.
    scopes, i = [frozenset()], 0
    while i < len(pattern):
        ch, flags = pattern[i], scopes[-1]
        if ch == "\\":
            text, i = _escape(pattern, i, in_class=False)
            out.append(text)
        elif ch == "[":
            text, i = _char_class(pattern, i, "i" in flags)
            out.append(text)
        elif ch == "(":
            text, i, inner, opens = _group(pattern, i, flags)
            out.append(text)
            if opens:
                scopes.append(inner)
            else:
                scopes[-1] = inner
        elif ch == ")":
            scopes.pop()
            out.append(ch)
            i += 1
        elif ch == "$" and "m" not in flags:
            out.append(r"\z")
            i += 1
        elif "i" in flags and ch.isalpha():
            out.append(_fold_letter(ch))
            i += 1
        else:
            out.append(ch)
            i += 1
    return "(?d)" + "".join(out)


def _group(text: str, i: int, flags: frozenset) -> tuple[str, int, frozenset, bool]:
    """A group's opening in Java syntax, where it ends, the flags after it, and whether it opens a scope."""
    if not text.startswith("(?", i):
        return "(", i + 1, flags, True
    for named in ("(?P<", "(?<"):
        if text.startswith(named, i):
            return "(?<", i + len(named), flags, True
    end = i + 2
    while text[end] not in ":)":
        end += 1
    on, _, off = text[i + 2:end].partition("-")
    if "U" in on + off:
        raise ValueError("invalid pattern: the flag U is not supported")
    inner = flags | set(on) - set(off) if on else flags
    inner = frozenset(inner - set(off))
    return text[i:end + 1], end + 1, inner, text[end] == ":"


# Shorter literals stand in most texts and rule nothing out.
LEAST_LITERAL = 3


def literals(pattern: str) -> frozenset[str] | None:
    """Texts of which every match holds at least one; ``None`` where the pattern names none of use.

    They are taken from the pattern's syntax tree: of a sequence the part that says most, of alternatives
    those of each. Patterns that fold case, or that only RE2 reads, have none.
    """
    try:
        tree = _parser.parse(without_groups(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return None
    found = _required(tree)
    return found if found and min(map(len, found)) >= LEAST_LITERAL else None


def _required(tree) -> frozenset[str] | None:
    best: frozenset[str] | None = None
    run: list[str] = []

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = found

    for kind, value in [*tree, (None, None)]:
        if kind is _parser.LITERAL:
            run.append(chr(value))
            continue
        offer(frozenset(["".join(run)]) if run else None)
        run = []
        if kind is _parser.SUBPATTERN:
            _, on, _, inner = value
            offer(None if on & re.IGNORECASE else _required(inner))
        elif kind is _parser.BRANCH:
            parts = [_required(part) for part in value[1]]
            offer(frozenset().union(*parts) if all(parts) else None)
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            offer(_required(value[2]))
    return best


def without_groups(pattern: str) -> str:
    """The same RE2 pattern, its groups capturing nothing."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        if pattern.startswith(r"\Q", i):
            end = pattern.find(r"\E", i)
            end = len(pattern) if end < 0 else end + 2
        elif pattern[i] == "\\":
            end = i + 2
        else:
            end = i + 1
        piece = pattern[i:end]
        if in_class:
            # A bracket that comes first, or as part of a named class, does not end it.
            posix = _POSIX_CLASS.match(pattern, i)
            if posix:
                piece, end = posix.group(0), posix.end()
            in_class = piece != "]"
        elif piece == "[":
            in_class = True
            for first in ("^", "]"):
                if pattern.startswith(first, end):
                    piece, end = piece + first, end + 1
        elif piece == "(":
            named = next((n for n in ("(?P<", "(?<") if pattern.startswith(n, i)), None)
            if named:
                piece, end = "(?:", pattern.index(">", i) + 1
            elif not pattern.startswith("(?", i):
                piece = "(?:"
        out.append(piece)
        i = end
    return "".join(out)


def compile_in_java(jvm, pattern: str) -> None:
    """Raise ``ValueError`` unless the JVM compiles the Java form of a pattern."""
    try:
        jvm.java.util.regex.Pattern.compile(to_java(pattern))
    except Py4JJavaError as error:
        raise ValueError(f"invalid pattern: {error.java_exception.getMessage()}") from None


def _fold_letter(ch: str) -> str:
    if ch.lower() in _FOLDS:
        return f"[{ch}{_FOLDS[ch.lower()]}]"
    if ord(ch) > 127:
        return "[" + "".join(sorted({ch, ch.lower(), ch.upper()} - {""})) + "]"
    return ch


def _escape(text: str, i: int, in_class: bool) -> tuple[str, int]:
    nxt = text[i + 1]
    if nxt == "s":
        return (_SPACE if in_class else f"[{_SPACE}]"), i + 2
    if nxt == "S":
        return f"[^{_SPACE}]", i + 2
    if nxt == "v":
        return r"\x0B", i + 2
    if nxt == "C":
        raise ValueError(r"invalid pattern: \C is not supported")
    if nxt in "pP":
        return _property(text, i)
    if nxt == "b" and not in_class:
        return _BOUNDARY, i + 2
    if nxt == "B" and not in_class:
        return _NOT_BOUNDARY, i + 2
    if nxt == "Q":
        end = text.find(r"\E", i)
        end = len(text) if end < 0 else end
        return re.escape(text[i + 2:end]), min(end + 2, len(text))
    return text[i:i + 2], i + 2


def _property(text: str, i: int) -> tuple[str, int]:
    """A Unicode class: general categories have one or two letters, scripts more."""
    negated = text[i + 1] == "P"
    if text[i + 2] == "{":
        end = text.index("}", i)
        name, end = text[i + 3:end], end + 1
    else:
        name, end = text[i + 2], i + 3
    if name.startswith("^"):
        negated, name = not negated, name[1:]
    if name == "Any":
        return ("[^\\x{0}-\\x{10ffff}]" if negated else "[\\x{0}-\\x{10ffff}]"), end
    name = name if len(name) <= 2 else f"Is{name}"
    return rf"\{'P' if negated else 'p'}{{{name}}}", end


def _char_class(text: str, i: int, fold: bool) -> tuple[str, int]:
    out, i = ["["], i + 1
    if text[i] == "^":
        out.append("^")
        i += 1
    if text[i] == "]":
        out.append(r"\]")
        i += 1
    begin = i
    while text[i] != "]":
        posix = _POSIX_CLASS.match(text, i)
        if posix:
            body = _POSIX[posix.group(2)]
            out.append(f"[^{body}]" if posix.group(1) else body)
            i = posix.end()
        elif text[i] == "\\":
            part, i = _escape(text, i, in_class=True)
            out.append(part)
        else:
            out.append("\\" + text[i] if text[i] in "[&" else text[i])
            i += 1
    if fold:
        body = text[begin:i]
        for letter, other in _FOLDS.items():
            if _covers(body, letter) or _covers(body, letter.upper()):
                out.append(other)
    out.append("]")
    return "".join(out), i + 1


def _covers(body: str, letter: str) -> bool:
    plain = re.sub(r"\\.", "", body)
    ranges = re.findall(r"(.)-(.)", plain)
    return letter in plain or any(lo <= letter <= hi for lo, hi in ranges)


def _glob_body(glob: str, double_star: bool) -> str:
    """Regex body of a glob; ``ValueError`` if the glob is malformed."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if double_star and glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif double_star and glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif ch == "*":
            out.append("[^/]*")
            i += 1
        elif ch == "?":
            out.append("[^/]")
            i += 1
        elif ch == "\\":
            if i + 1 == len(glob):
                raise ValueError(f"malformed glob: {glob}")
            out.append(re.escape(glob[i + 1]))
            i += 2
        elif ch == "[":
            part, i = _glob_class(glob, i)
            out.append(part)
        else:
            out.append(re.escape(ch))
            i += 1
    return "".join(out)


def _glob_class(glob: str, i: int) -> tuple[str, int]:
    start, i = i, i + 1
    negated = glob[i:i + 1] == "^"
    i += negated
    items = []

    def take(i):
        if glob[i:i + 1] in ("", "-", "]"):
            raise ValueError(f"malformed glob: {glob}")
        if glob[i] == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"malformed glob: {glob}")
        return glob[i], i + 1

    while glob[i:i + 1] != "]" or not items:
        low, i = take(i)
        high = low
        if glob[i:i + 1] == "-":
            high, i = take(i + 1)
        if low <= high:
            items.append((low, high))
        else:
            items.append(None)
        if i >= len(glob):
            raise ValueError(f"malformed glob: {glob}")
    ranges = "".join(f"\\x{{{ord(p[0]):x}}}-\\x{{{ord(p[1]):x}}}" for p in items if p)
    if not ranges:
        return ("[^/]" if negated else "[^\\x{0}-\\x{10ffff}]"), i + 1
    return f"[{'^/' if negated else ''}{ranges}]", i + 1


def glob_pattern(glob: str, mode: str = "intent", ancestors: bool = True) -> str | None:
    """Java pattern for a path that an include or exclude glob selects.

    With ``ancestors`` the glob may also select a directory above the path, as
    when an excluded directory drops its subtree. ``None`` means the glob can
    select nothing (a malformed one is ignored).

    Intent: ``**`` spans any number of segments; a glob without ``/`` is tried
    on every base name. Reference: with exactly one ``**`` the text before it
    is a plain string prefix of the path and the text after it a glob for the
    base name; any other glob is tried on the base name only.
    """
    below = "(?:/.*)?" if ancestors else ""
    try:
        if mode == "intent":
            body = _glob_body(glob, double_star=True)
            if glob.endswith("/**"):
                body = _glob_body(glob[:-3], double_star=True) + "/.*"
            head = "" if "/" in glob else "(?:.*/)?"
            return f"(?s)^{head}{body}{below}\\z"
        parts = glob.split("**")
        if len(parts) == 2:
            prefix = parts[0].removesuffix("/")
            suffix = parts[1].removeprefix("/")
            if not suffix:
                return f"(?s)^{re.escape(prefix)}"
            if "/" in suffix:
                return None
            name = _glob_body(suffix, double_star=False)
            cut = prefix.rfind("/") + 1
            inside = f"{re.escape(prefix[:cut])}(?={re.escape(prefix[cut:])}){name}"
            beyond = f"{re.escape(prefix)}[^/]*/(?:.*/)?{name}"
            return f"(?s)^(?:{inside}|{beyond}){below}\\z"
        if "/" in glob:
            return None
        return f"(?s)^(?:.*/)?{_glob_body(glob, double_star=False)}{below}\\z"
    except ValueError:
        return None
