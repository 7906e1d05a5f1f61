"""Text columns: decoding, line splitting and the string helpers rules use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.sql import quote

# The characters Unicode counts as white space.
UNICODE_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


# Metadata entry of a text that was repaired: bytes of its longest line as given.
LONGEST_LINE = "longest_line"


def longest_line(content: Column) -> Column:
    """Bytes of the longest line, without newlines, of a text with bad bytes; else null."""
    # In this charset every byte is a character.
    lines = F.split(F.decode(content.cast("binary"), "ISO-8859-1"), "\n", -1)
    longest = F.array_max(F.transform(lines, lambda l: F.length(l)))
    return F.when(~F.is_valid_utf8(content.cast("string")), longest)


def decode(content: Column) -> Column:
    """Bytes or text to valid UTF-8 text; bad bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def split_lines(content: Column) -> Column:
    """Array of lines: a final newline adds none, each loses one trailing return."""
    def ended(lines: Column) -> Column:
        final = (F.size(lines) > 1) & (F.try_element_at(lines, F.lit(-1)) == "")
        return F.when(final, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)

    # Cut first: to take a sign off a whole text counts and copies all of it.
    lines = F.get(F.transform(F.array(F.split(content, "\n", -1)), ended), F.lit(0))
    short = F.transform(lines, lambda line: _drop_end(line, "\r"))
    return F.when(content.contains("\r"), short).otherwise(lines)


def _drop_end(value: Column, end: str) -> Column:
    cut = value.substr(F.lit(1), F.length(value) - len(end))
    return F.when(value.endswith(end), cut).otherwise(value)


def has_long_line(content: Column, max_bytes: int) -> Column:
    """Whether some line, without its newline, has ``max_bytes`` bytes or more."""
    long_line = F.exists(F.split(content, "\n", -1), lambda l: F.octet_length(l) >= max_bytes)
    return F.when(F.octet_length(content) >= max_bytes, long_line).otherwise(F.lit(False))


def trim_space_sql(value: str) -> str:
    """The text without leading and trailing white space of any kind."""
    pattern = quote(f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z")
    return f"regexp_replace({value}, {pattern}, '')"


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three dots when cut."""
    cut = F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def extension_sql(path: str) -> str:
    """The last dot of the base name and what follows; empty without a dot."""
    base = f"substring_index({path}, '/', -1)"
    tail = f"concat('.', substring_index({base}, '.', -1))"
    return f"CASE WHEN contains({base}, '.') THEN {tail} ELSE '' END"


def human_size_sql(size: str) -> str:
    """A byte count as text in powers of 1024; halves are rounded to even."""
    cases = []
    for power, letter in reversed(list(enumerate("KMGTPE", start=1))):
        unit = 1024**power
        scaled = f"bround({size} / {float(unit)!r}D, 1)"
        cases.append(f"WHEN {size} >= {unit} THEN format_string('%.1f {letter}B', {scaled})")
    small = f"format_string('%d B', CAST({size} AS BIGINT))"
    return f"CASE {' '.join(cases)} ELSE {small} END"


# Named character references of quotes and brackets; the ampersand's comes last.
NAMED_REFERENCES = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"))
_NUMBER = r"^0*([0-9]{1,7});"
_HEX_NUMBER = r"^[xX]0*([0-9a-fA-F]{1,6});"


def _decoded_number(part: Column) -> Column:
    """What follows ``&#`` with a leading character number decoded, where it names a character."""
    digits = F.regexp_extract(part, _NUMBER, 1)
    hexed = F.regexp_extract(part, _HEX_NUMBER, 1)
    code = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
    known = ((code > 0) & (code < 0xD800) | (code > 0xDFFF) & (code <= 0x10FFFF)) & (code != ord("&"))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    rest = F.regexp_replace(part, "^[0-9a-fA-FxX]+;", "")
    return F.when(known, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), part))


def unescape_html(text: Column) -> Column:
    """Decode the character references that hide text in markup, each once."""
    parts = F.split(text, "&#", -1)
    numbered = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _decoded_number)
    plain = F.when(text.contains("&#"), F.concat(parts[0], F.array_join(numbered, ""))).otherwise(text)
    for name, char in NAMED_REFERENCES:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    plain = F.regexp_replace(plain, "&(?:amp|#0*38|#[xX]0*26);", "&")
    return F.when(text.contains("&"), plain).otherwise(text)
