"""Scanners of one's own next to the built-in rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.model import FILE, FINDING_COLUMNS, MISCONFIGURATION, REFERENCE, ScanOptions
from auditlake.operators.match import find


@dataclass(frozen=True)
class Scanner:
    """A named function from targets to findings, and the target types it takes.

    ``find`` gets rows of ``path type content metadata`` and returns the finding
    columns. It should stay narrow, as the built-in rules do.
    """

    name: str
    find: Callable[[DataFrame], DataFrame]
    types: tuple[str, ...] = (FILE,)
    description: str = ""


@dataclass(frozen=True)
class ColumnScanner:
    """A scanner that takes part in the one pass over the targets (``ScanOptions.own_scanners``).

    ``find`` gets the columns of path and text and returns an array of structs
    with ``rule_id title severity line_no match`` and, if wanted,
    ``description`` and ``remediation``. Its findings are in results, totals,
    reports and streams like any other.
    """

    name: str
    find: Callable[[Column, Column], Column]
    fields: tuple[str, ...] = ("rule_id", "title", "severity", "line_no", "match")
    types: tuple[str, ...] = (FILE,)
    kind: str = MISCONFIGURATION


_PYTHON_FIELDS = ("rule_id", "title", "severity", "line_no", "match", "description", "remediation")


def python_scanner(
    name: str,
    find: Callable[[str, str], Iterable[dict]],
    types: tuple[str, ...] = (FILE,),
    kind: str = MISCONFIGURATION,
) -> ColumnScanner:
    """A scanner written in Python that takes part in the one pass over the targets.

    ``find`` gets path and text of one target and gives a mapping for each finding: ``rule_id``,
    ``title``, ``severity``, ``line_no``, ``match`` and, if wanted, ``description`` and
    ``remediation``. It runs in Python workers over Arrow batches, next to the gate; a text that is
    null has no findings, and what ``find`` raises ends the scan.
    """
    kinds = pa.struct([(f, pa.int32() if f == "line_no" else pa.string()) for f in _PYTHON_FIELDS])
    ddl = ",".join(f"`{f.name}`:{'int' if f.name == 'line_no' else 'string'}" for f in kinds)

    @F.arrow_udf(f"array<struct<{ddl}>>")
    def scan(path: pa.Array, content: pa.Array) -> pa.Array:
        found = [
            [{"description": "", "remediation": "", **f} for f in find(p, c)] if c is not None else []
            for p, c in zip(path.to_pylist(), content.to_pylist())
        ]
        return pa.array(found, pa.list_(kinds))

    # The optimizer may not work it out twice.
    scan = scan.asNondeterministic()
    return ColumnScanner(name, lambda path, content: scan(path, content), _PYTHON_FIELDS, types, kind)


def find_with(
    targets: DataFrame, scanners: Iterable[Scanner], options: ScanOptions | None = None
) -> DataFrame:
    """Findings of the built-in rules and of further scanners, one after the other.

    In reference mode the rule lists name scanners, so they pick these as well.
    """
    options = options or ScanOptions()
    found = find(targets, options)
    for scanner in scanners:
        if options.mode == REFERENCE and (
            (options.enabled_rules and scanner.name not in options.enabled_rules)
            or scanner.name in options.disabled_rules
        ):
            continue
        own = scanner.find(targets.filter(F.col("type").isin(*scanner.types)))
        found = found.unionByName(own.select(*FINDING_COLUMNS))
    return found
