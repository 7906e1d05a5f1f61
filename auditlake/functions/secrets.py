"""Masking and entropy of secret text, as Spark SQL text."""

from __future__ import annotations

from auditlake.functions.sql import quote

# Least entropy, in bits per character, of an unnamed secret.
HEX_ENTROPY = 3.0
TEXT_ENTROPY = 4.5

CANDIDATE = r"""['"]([0-9a-f]{32,}|[0-9A-Za-z+/_-]{32,}={0,2})['"]"""


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def mask(value: str) -> str:
    """Show at most four characters at each end of a text over eight long."""
    shown = (
        "concat(left(s, 4), repeat('*', length(s) - 8), right(s, least(4, length(s) - 8)))"
    )
    hidden = "repeat('*', length(s))"
    return bind(value, "s", f"CASE WHEN length(s) <= 8 THEN {hidden} ELSE {shown} END")


def shannon_entropy(value: str) -> str:
    """Bits per character of an ASCII text; zero for an empty one."""
    share = f"((length({value}) - length(replace({value}, ch, ''))) / length({value}))"
    chars = f"array_distinct(filter(split({value}, ''), ch -> ch <> ''))"
    return f"aggregate({chars}, 0.0D, (bits, ch) -> bits - {share} * log2({share}))"


def candidates(value: str) -> str:
    """All quoted tokens of a line that are long enough to be a secret."""
    return f"regexp_extract_all({value}, {quote(CANDIDATE)}, 1)"


def random_candidates(value: str) -> str:
    """The candidates whose entropy is above the limit of their alphabet."""
    return random_ones(candidates(value))


def random_ones(tokens: str) -> str:
    """Those of an array of tokens whose entropy is above the limit of their alphabet."""
    limit = (
        f"CASE WHEN c RLIKE '^[0-9a-f]{{32,}}$' THEN {HEX_ENTROPY}D ELSE {TEXT_ENTROPY}D END"
    )
    return f"filter({tokens}, c -> {shannon_entropy('c')} > {limit})"
