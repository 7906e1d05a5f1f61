"""Where a walk over a file tree need not go, told from the globs of a scan.

A folder is left out if everything below it is excluded, or nothing below it can be included. Only what
the path filters (``operators.paths``) would drop file by file is left out, so results do not change.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from auditlake.functions.regex import _glob_body, glob_pattern
from auditlake.model import INTENT

_CODE = re.compile(r"\\x\{([0-9a-f]+)\}")


def _compiled(java: str) -> re.Pattern:
    """A glob's Java pattern for this side."""
    return re.compile(_CODE.sub(lambda m: rf"\U{int(m[1], 16):08x}", java).replace(r"\z", r"\Z"))


class _Segments:
    """A glob as an automaton over the segments of a path: which parts of it a folder has come to."""

    def __init__(self, glob: str):
        self.parts: list[re.Pattern | str] = []
        for part in glob.split("/"):
            # A doubled star inside a segment may span several: from there on all is possible.
            inner = "**" in part and part != "**"
            self.parts.append("*" if inner else "**" if part == "**" else _compiled(rf"(?s)^{_glob_body(part, False)}\z"))

    def _resting(self, states: set[int]) -> set[int]:
        """The states with those that follow without a segment: a doubled star may stand for none."""
        for i in sorted(states):
            while i < len(self.parts) and self.parts[i] == "**":
                i += 1
                states.add(i)
        return states

    def may_hold(self, folder: str) -> bool:
        """Whether a path below the folder may match."""
        states = self._resting({0})
        for name in folder.split("/") if folder else ():
            after: set[int] = set()
            for i in states:
                part = self.parts[i] if i < len(self.parts) else None
                if part == "*":
                    return True
                if part == "**":
                    after.add(i)
                elif part is not None and part.search(name):
                    after.add(i + 1)
            states = self._resting(after)
        return any(i < len(self.parts) for i in states) or any(self.parts[i - 1] == "**" for i in states if i)


class Pruner:
    """The folders a walk enters under some globs; folders are spelt as the globs see paths."""

    def __init__(self, excludes: Iterable[str] = (), includes: Iterable[str] = (), mode: str = INTENT):
        self.mode, self.includes = mode, tuple(includes)
        self.dropped: list[tuple[re.Pattern, bool]] = []
        for glob in excludes:
            java = glob_pattern(glob, mode, ancestors=True)
            if java:
                # ``folder/**`` takes in all that lies in the folder, not the folder itself.
                self.dropped.append((_compiled(java), glob.endswith("/**")))
        self.automata = {g: _Segments(g) for g in self.includes if mode == INTENT and self._by_segments(g)}

    @staticmethod
    def _by_segments(glob: str) -> bool:
        """Whether the glob goes by the whole path, and no bracket of it stands across segments."""
        return "/" in glob and "[" not in glob and "\\" not in glob and glob_pattern(glob) is not None

    def _may_include(self, glob: str, folder: str) -> bool:
        if self.mode == INTENT:
            return glob not in self.automata or self.automata[glob].may_hold(folder)
        if glob_pattern(glob, self.mode, ancestors=False) is None:
            return False
        parts = glob.split("**")
        if len(parts) != 2:
            return True
        head = parts[0].removesuffix("/")
        return folder.startswith(head) or head.startswith(f"{folder}/") or not folder

    def enters(self, folder: str) -> bool:
        for pattern, inside in self.dropped:
            if folder and (pattern.search(folder) or inside and pattern.search(f"{folder}/")):
                return False
        return not self.includes or any(self._may_include(g, folder) for g in self.includes)
