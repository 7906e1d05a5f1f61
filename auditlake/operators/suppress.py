"""Findings that a user has accepted: a table of exceptions, joined to the findings.

An exception names a fingerprint (the ``id`` of a finding), or a rule, a path glob, or both; ``until`` ends
it. Both tables may be large: nothing is broadcast, and no finding meets every exception. A glob
goes by the whole path. It is filed under the longest text it fixes: what stands before its first wildcard,
or the literal base name or extension at its end. A finding looks itself up under each beginning of its path
that is as long as some filed one, each name on it and each extension, by equality; only globs found there
are tried on its path. Globs that fix nothing (such as ``**``) are filed by their rule, or, without one,
under one key that every finding looks up.

Findings keep their order of columns. An exception with neither fingerprint, rule nor glob, or with a
malformed glob, covers nothing. Null paths are covered by fingerprint or rule alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.regex import glob_pattern

SCHEMA = "fingerprint string, rule_id string, path_glob string, reason string, until date"
_WILD = frozenset("*?[\\")
# In a name on its own a closing bracket may be the end of a class that began before it.
_WILD_IN_NAME = _WILD | {"]"}


def filed_under(glob: str) -> str:
    """The key a glob is filed under: the beginning of a path, a base name, an extension, or nothing."""
    fixed = 0
    while fixed < len(glob) and glob[fixed] not in _WILD:
        fixed += 1
    # Without a slash a glob is tried on every name of a path; ``a/**/b`` covers ``a/b`` as well.
    begin = glob[:fixed] if "/" in glob else ""
    base = glob.rpartition("/")[2]
    if not _WILD_IN_NAME & set(base):
        return f"named:{base}" if len(base) > len(begin) or not begin else f"in:{begin}"
    ending = base.rpartition(".")[2] if "." in base else ""
    if ending and not _WILD_IN_NAME & set(ending) and len(ending) > len(begin):
        return f"ending:{ending}"
    return f"in:{begin}" if begin else ""


def _compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        globs = batch.column("path_glob").to_pylist()
        # A glob covers what lies below a folder it selects, as an exclude glob does.
        patterns = [g and glob_pattern(g, ancestors=True) for g in globs]
        keys = [g and filed_under(g) for g in globs]
        yield batch.append_column("_pattern", pa.array(patterns, pa.string())).append_column("_key", pa.array(keys, pa.string()))


def _filed(exceptions: DataFrame, at: Column) -> DataFrame:
    """The exceptions in force that go by rule or glob, with key and pattern; copies once."""
    due = exceptions.filter(F.col("fingerprint").isNull() & (F.col("until").isNull() | (F.col("until") >= at)))
    named = due.select("rule_id", "path_glob", "reason").filter("rule_id IS NOT NULL OR path_glob IS NOT NULL")
    rows = named.groupBy("rule_id", "path_glob").agg(F.min("reason").alias("reason"))
    filed = rows.select("rule_id", "path_glob", "reason").mapInArrow(
        _compiled, "rule_id string, path_glob string, reason string, _pattern string, _key string"
    )
    known = filed.filter("path_glob IS NULL OR _pattern IS NOT NULL")
    # What fixes no part of a path goes by its rule.
    key = F.when(F.coalesce("_key", F.lit("")) != "", F.col("_key")).otherwise(F.concat(F.lit("rule:"), F.coalesce("rule_id", F.lit("*"))))
    return known.select(F.col("rule_id").alias("_rule"), "_pattern", F.col("reason").alias("_reason"), key.alias("_key"))


def _looked_up(path: Column, rule: Column, lengths: Column) -> Column:
    """All keys under which an exception for a path and rule may be filed, of beginnings those of given lengths."""
    parts = F.split(path, "/", -1)
    begins = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.concat(F.lit("in:"), path.substr(F.lit(1), n)))
    base = F.element_at(parts, -1)
    # An exception for a folder covers what lies in it, so that each name above counts as well.
    names = F.flatten(F.transform(parts, lambda p: F.array(
        F.concat(F.lit("named:"), p), F.when(p.contains("."), F.concat(F.lit("ending:"), F.substring_index(p, ".", -1)))
    )))
    own = F.array(F.concat(F.lit("rule:"), rule), F.lit("rule:*"))
    by_path = F.when(base.isNotNull(), F.concat(names, begins))
    return F.array_distinct(F.array_compact(F.concat(own, F.coalesce(by_path, F.array().cast("array<string>")))))


def _joined_by_exchange(rows: DataFrame) -> DataFrame:
    """Rows that a join does not send through the driver, however small Spark takes them to be.

    Spark rates texts made of keys, and the keys a path explodes into, by the few bytes of the column they
    come from, and does not go back on a broadcast once it knows better, as that would cost an exchange.
    """
    return rows.hint("merge")


def marked(findings: DataFrame, exceptions: DataFrame, at: Column | None = None) -> DataFrame:
    """Findings with ``suppressed`` and, of one exception that covers them, ``reason``.

    ``exceptions`` has the columns of ``SCHEMA``; ``at`` is the day it is judged by, today if not given.
    """
    at = F.current_date() if at is None else at
    exact = exceptions.filter(F.col("fingerprint").isNotNull() & (F.col("until").isNull() | (F.col("until") >= at)))
    exact = exact.groupBy("fingerprint").agg(F.coalesce(F.min("reason"), F.lit("")).alias("_exact"))
    # Each place and rule is looked up once, however often it comes.
    places = findings.select("rule_id", "file_path").distinct()
    filed = _filed(exceptions, at)
    # One array, no longer than the longest glob.
    begins = filed.filter(F.col("_key").startswith("in:")).select((F.length("_key") - len("in:")).alias("n"))
    lengths = begins.agg(F.collect_set("n")).scalar()
    keyed = places.withColumn("_lengths", lengths).select(
        "rule_id", "file_path", F.explode(_looked_up(F.col("file_path"), F.col("rule_id"), F.col("_lengths"))).alias("_key")
    )
    same_rule = F.col("_rule").isNull() | (F.col("_rule") == F.col("rule_id"))
    matched = keyed.join(_joined_by_exchange(filed), "_key").filter(
        same_rule & (F.col("_pattern").isNull() | F.coalesce(F.rlike(F.col("file_path"), F.col("_pattern")), F.lit(False)))
    )
    covered = matched.groupBy("rule_id", "file_path").agg(F.coalesce(F.min("_reason"), F.lit("")).alias("_covered"))
    covered = covered.select(F.col("rule_id").alias("_r"), F.col("file_path").alias("_p"), "_covered")
    same = F.col("rule_id").eqNullSafe(F.col("_r")) & F.col("file_path").eqNullSafe(F.col("_p"))
    joined = findings.join(_joined_by_exchange(exact), F.col("id") == F.col("fingerprint"), "left")
    joined = joined.join(_joined_by_exchange(covered), same, "left")
    reason = F.coalesce("_exact", "_covered")
    return joined.select(*findings.columns, reason.isNotNull().alias("suppressed"), reason.alias("reason"))


def unsuppressed(findings: DataFrame, exceptions: DataFrame, at: Column | None = None) -> DataFrame:
    """The findings that no exception covers."""
    return marked(findings, exceptions, at).filter("NOT suppressed").select(findings.columns)
