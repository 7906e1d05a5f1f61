"""Small pieces of Spark SQL text.

Rules are many and each is small, so their conditions are written as SQL text:
one parsed expression instead of a call into the JVM per operator.
"""

from __future__ import annotations

from auditlake.functions.regex import to_java


def quote(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def rlike(value: str, pattern: str) -> str:
    """Whether an RE2 pattern matches somewhere in a value."""
    return f"({value} RLIKE {quote(to_java(pattern))})"
