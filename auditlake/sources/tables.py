"""Targets from tables of text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.model import FILE


def file_metadata(path: str, size: str) -> Column:
    """The ``extension`` and human ``size`` of a target, from SQL text."""
    size, extension = text.human_size_sql(size), text.extension_sql(path)
    return F.expr(f"map('size', {size}, 'extension', {extension})")


def targets_from_table(
    rows: DataFrame,
    path: Column | str,
    content: Column | str,
    unescape_html: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One target per row of any batch or streaming table; ``keep`` names columns to leave beside it."""
    path = F.expr(path) if isinstance(path, str) else path
    content = F.expr(content) if isinstance(content, str) else content
    body = text.decode(content)
    if unescape_html:
        body = text.unescape_html(body)
    named = rows.select(
        path.cast("string").alias("path"),
        body.alias("content"),
        text.longest_line(content).alias("longest"),
        *keep,
    )
    metadata = with_longest_line(file_metadata("path", "octet_length(content)"), F.col("longest"))
    return named.select("path", F.lit(FILE).alias("type"), "content", metadata.alias("metadata"), *keep)


def with_longest_line(metadata: Column, longest: Column) -> Column:
    """Metadata that also says how long the longest line of a repaired text was."""
    more = F.map_concat(metadata, F.create_map(F.lit(text.LONGEST_LINE), longest.cast("string")))
    return F.when(longest.isNull(), metadata).otherwise(more)


def union_targets(*targets: DataFrame) -> DataFrame:
    """All targets of several roots or tables, appended without removing any."""
    return reduce(DataFrame.unionByName, targets)
