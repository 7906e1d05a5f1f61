"""SARIF 2.1.0: results, rules, documents and their check."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.order import placed, stored
from auditlake.sinks.common import DOCUMENT_SIZE, documents, slashes

TOOL_NAME = "auditlake"
TOOL_VERSION = "1.0.0"
TOOL_URI = "https://example.org/auditlake"
TOOL_FULL_NAME = "auditlake, secrets and misconfiguration"
TOOL_ORGANIZATION = "auditlake"
# Runs in one merged document.
RUNS = 100
# Characters of a run's results that ranges are chosen by, and what stands before the results.
BEGIN = 1_000
_RESULTS = '"results":['
# The fields of a finding that its rule's descriptor is made of.
_RULE_FIELDS = ("rule_id", "title", "description", "severity", "type", "remediation")
# Fixed values of the SARIF format.
VERSION = "2.1.0"
SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"

DOCUMENT_SCHEMA = """version STRING, runs ARRAY<STRUCT<
 tool: STRUCT<driver: STRUCT<name: STRING, rules: ARRAY<STRUCT<id: STRING>>>>,
 results: ARRAY<STRUCT<ruleId: STRING, level: STRING>>>>, broken STRING"""


def level(severity: Column) -> Column:
    return (
        F.when(severity.isin("CRITICAL", "HIGH"), "error")
        .when(severity == "MEDIUM", "warning")
        .when(severity == "LOW", "note")
        .otherwise("none")
    )


def github_level(severity: Column) -> Column:
    """As ``level``, but never ``none``."""
    return (
        F.when(severity.isin("CRITICAL", "HIGH"), "error")
        .when(severity == "MEDIUM", "warning")
        .otherwise("note")
    )


def help_uri(rule_id: Column) -> Column:
    return F.concat(F.lit(f"{TOOL_URI}/rules/"), F.lower(rule_id))


def relative_path(path: Column, root: str) -> Column:
    """The path below a root: the root goes as a plain prefix, then one ``/`` and one ``\\``."""
    if not root:
        return path
    below = path.substr(F.lit(len(root) + 1), F.length(path))
    below = F.regexp_replace(F.regexp_replace(below, "^/", ""), r"^\\", "")
    return F.when(path.startswith(root), below).otherwise(path)


def _location(uri: Column, start: Column, end: Column, match: Column | None) -> Column:
    region = [start.alias("startLine"), end.alias("endLine")]
    if match is not None:
        snippet = F.when(match != "", F.struct(match.alias("text")))
        region.append(snippet.alias("snippet"))
    physical = F.struct(
        F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(*region).alias("region")
    )
    return F.array(F.struct(physical.alias("physicalLocation")))


def result(f: Column) -> Column:
    """A SARIF result from a finding struct."""
    return F.struct(
        f["rule_id"].alias("ruleId"),
        level(f["severity"]).alias("level"),
        F.struct(f["description"].alias("text")).alias("message"),
        _location(slashes(f["file_path"]), f["start_line"], f["end_line"], f["match"]).alias(
            "locations"
        ),
        F.struct(f["id"].alias("primaryLocationLineHash")).alias("fingerprints"),
    )


def github_result(f: Column, root: str) -> Column:
    """A result without snippet and fingerprint, with a path below the root."""
    return F.struct(
        f["rule_id"].alias("ruleId"),
        github_level(f["severity"]).alias("level"),
        F.struct(f["description"].alias("text")).alias("message"),
        _location(
            relative_path(f["file_path"], root), f["start_line"], f["end_line"], None
        ).alias("locations"),
    )


def rule(f: Column, github: bool = False) -> Column:
    """The descriptor of a finding's rule."""
    fields = [
        f["rule_id"].alias("id"),
        f["title"].alias("name"),
        F.struct(f["description"].alias("text")).alias("shortDescription"),
    ]
    if github:
        setting = F.struct(github_level(f["severity"]).alias("level"))
        return F.struct(*fields, setting.alias("defaultConfiguration"))
    return F.struct(
        *fields,
        help_uri(f["rule_id"]).alias("helpUri"),
        F.struct(level(f["severity"]).alias("level")).alias("defaultConfiguration"),
        F.struct(
            f["severity"].alias("severity"), f["type"].alias("type"),
            f["remediation"].alias("remediation"),
        ).alias("properties"),
    )


def _driver(fs: Column, github: bool) -> Column:
    fields = [
        F.lit(TOOL_NAME).alias("name"),
        F.lit(TOOL_VERSION).alias("version"),
        F.lit(TOOL_URI).alias("informationUri"),
    ]
    if github:
        fields.append(F.lit(TOOL_VERSION).alias("semanticVersion"))
    else:
        fields += [
            F.lit(TOOL_FULL_NAME).alias("fullName"), F.lit(TOOL_ORGANIZATION).alias("organization")
        ]
    # Flat structs first: a comparison of nested ones costs as much as a finding's own text.
    flat = F.transform(fs, lambda f: F.struct(*(f[c].alias(c) for c in _RULE_FIELDS)))
    rules = F.array_distinct(F.transform(F.array_distinct(flat), lambda f: rule(f, github)))
    return F.struct(*fields, rules.alias("rules"))


def run(fs: Column, start: dt.datetime | None = None, end: dt.datetime | None = None) -> Column:
    """A SARIF run from an array of findings."""
    fields = [
        F.struct(_driver(fs, github=False).alias("driver")).alias("tool"),
        F.transform(fs, result).alias("results"),
    ]
    if start and end:
        invocation = F.struct(
            F.lit(True).alias("executionSuccessful"),
            F.lit(start.isoformat()).alias("startTimeUtc"),
            F.lit(end.isoformat()).alias("endTimeUtc"),
        )
        fields.append(F.array(invocation).alias("invocations"))
    return F.struct(*fields)


def github_run(fs: Column, root: str) -> Column:
    return F.struct(
        F.struct(_driver(fs, github=True).alias("driver")).alias("tool"),
        F.transform(fs, lambda f: github_result(f, root)).alias("results"),
    )


def document(runs: Column) -> Column:
    """The JSON text of a report with the given runs."""
    return F.to_json(
        F.struct(
            F.lit(SCHEMA_URI).alias("$schema"), F.lit(VERSION).alias("version"), runs.alias("runs")
        )
    )


def sarif_documents(
    findings: DataFrame,
    group: str,
    size: int = DOCUMENT_SIZE,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """SARIF documents of each group; see ``common.documents``."""
    return documents(
        findings, group, lambda fs: document(F.array(run(fs, start, end))), size, groups
    )


def github_documents(
    findings: DataFrame,
    group: str,
    root: str = "",
    size: int = DOCUMENT_SIZE,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Documents in the variant for GitHub, with paths below ``root``."""
    return documents(
        findings, group, lambda fs: document(F.array(github_run(fs, root))), size, groups
    )


def single_result(root: str = "", github: bool = False) -> Column:
    """The JSON text of the result of a row of findings."""
    finding = F.struct(*(F.col(c).alias(c) for c in ("id", "rule_id", "severity", "description", "file_path", "start_line", "end_line", "match")))
    return F.to_json(github_result(finding, root) if github else result(finding))


def single_ends(findings: DataFrame, github: bool, start: dt.datetime, end: dt.datetime) -> tuple[str, str]:
    """What stands before and after the results in one document: it names each rule that fired, a row per rule."""
    named = findings.groupBy("rule_id").agg(
        *(F.min(c).alias(c) for c in ("title", "description", "severity", "type", "remediation"))
    )
    rules = F.sort_array(F.collect_list(F.struct(*named.columns, *_empty_fields())))
    tool = named.agg(rules.alias("rules")).select(F.to_json(F.struct(_driver(F.col("rules"), github).alias("driver")))).first()[0]
    times = "" if github else (
        f',"invocations":[{{"executionSuccessful":true,"startTimeUtc":"{start.isoformat()}","endTimeUtc":"{end.isoformat()}"}}]'
    )
    head = f'{{"$schema":"{SCHEMA_URI}","version":"{VERSION}","runs":[{{"tool":{tool},"results":['
    return head, f"]{times}}}]}}"


def _empty_fields() -> list[Column]:
    """Fields of a finding that a rule's descriptor does not read."""
    kinds = (("id", "string"), ("file_path", "string"), ("start_line", "int"), ("end_line", "int"), ("match", "string"))
    return [F.lit(None).cast(kind).alias(name) for name, kind in kinds]


def merge_reports(*reports: DataFrame) -> DataFrame:
    """The runs of several reports as rows of one, none dropped.

    Each report has a ``document`` column; runs come back as JSON text in
    ``run``, ready to be put in one document or written one per row.
    """
    merged = reports[0].select("document")
    for report in reports[1:]:
        merged = merged.unionByName(report.select("document"))
    runs = F.from_json(F.get_json_object("document", "$.runs"), "array<string>")
    return merged.select(F.explode(runs).alias("run"))


def _in_text_order(rows: DataFrame) -> DataFrame:
    """Runs in the order of their text, with ``part`` and ``position``; see ``order.placed``.

    Whole runs are too long to choose ranges by. Many share all that stands before their results, the tool and
    its rules; these heads are put in order, each once, and runs by the place of their head and what follows it.
    No head that ends where results begin is the beginning of another, so that this is the order of the whole text.
    """
    at = F.locate(_RESULTS, F.col("run"))
    end = F.when(at > 0, at + len(_RESULTS) - 1).otherwise(F.length("run"))
    parted = rows.withColumn("_head", F.col("run").substr(F.lit(1), end))
    heads = placed(parted.select("_head").distinct(), "_head").withColumnsRenamed({"part": "_head_part", "position": "_head_at"})
    begun = parted.withColumn("_begin", F.col("run").substr(end + 1, F.lit(BEGIN)))
    keyed = begun.join(stored(heads, "heads"), "_head").drop("_head")
    keys = ("_head_part", "_head_at", "_begin")
    return placed(keyed, *keys, within=("run",)).drop(*keys)


def merged_documents(*reports: DataFrame, runs: int = RUNS) -> DataFrame:
    """Documents of many runs: those of all reports, ``runs`` to a document, in the order of their text."""
    ordered = stored(_in_text_order(stored(merge_reports(*reports), "runs")), "ordered-runs")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    chunk = F.floor((F.col("offset") + F.col("position")) / runs)
    gathered = ordered.join(F.broadcast(offsets), "part").groupBy(chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list("run")).alias("found")
    )
    text = F.concat(
        F.lit('{"$schema":"' + SCHEMA_URI + '","version":"' + VERSION + '","runs":['),
        F.array_join("found", ","), F.lit("]}"),
    )
    return gathered.select("chunk", F.size("found").cast("bigint").alias("runs"), text.alias("document"))


def validate(reports: DataFrame) -> DataFrame:
    """Reports with ``valid``: whether the document parses as SARIF."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    parsed = F.from_json("document", DOCUMENT_SCHEMA, options)
    return reports.withColumn("parsed", parsed).withColumn(
        "valid",
        F.coalesce(
            F.col("parsed.broken").isNull()
            & (F.col("parsed.version") == VERSION)
            & F.col("parsed.runs").isNotNull(),
            F.lit(False),
        ),
    )
