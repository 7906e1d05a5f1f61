"""JSON, SARIF, Markdown and table reports, as folders of parts or as one file each.

In a folder, parts of the Markdown and table reports are in report order. With ``single`` a report
is one file (see ``sinks.single``): one JSON or SARIF document, or one text.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import truncate
from auditlake.operators.order import ORDER, numbered, stored, with_rank
from auditlake.operators.summary import severity_share, summarize, unnest, verdict
from auditlake.sinks import sarif
from auditlake.sinks.common import (
    DESCRIPTION_WIDTH,
    DOCUMENT_SIZE,
    MATCH_WIDTH,
    REMEDIATION_WIDTH,
)
from auditlake.sinks.single import write_single

REPORT_VERSION = "1.0.0"
# The sign of each severity in Markdown.
EMOJI = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🔵"}
OTHER_EMOJI = "⚪"
# Closing line of a table report by verdict.
CLOSING = {
    "fix": "Critical or high findings: fix them before release.",
    "consider": "Medium findings: consider fixing them.",
    "low_only": "Low findings only.",
    "clean": "No findings.",
}


def json_result(error: Column, findings: Column) -> Column:
    """The JSON text of one target's result; no findings are ``null``."""
    listed = F.when(F.size(findings) > 0, findings)
    target = F.struct(F.col("path"), F.col("type"), F.col("metadata"))
    return F.to_json(
        F.struct(target.alias("target"), listed.alias("findings"), error.alias("error")),
        {"ignoreNullFields": "false"},
    )


def json_rows(results: DataFrame) -> DataFrame:
    """One JSON line per target."""
    line = json_result(F.col("error"), F.col("findings"))
    return results.select("path", line.alias("value"))


def emoji(severity: Column) -> Column:
    sign = F.lit(OTHER_EMOJI)
    for name, char in EMOJI.items():
        sign = F.when(severity == name, char).otherwise(sign)
    return sign


def markdown_section(ordinal: Column) -> Column:
    """The Markdown text of a finding with its number: a heading, a row of facts, and what to do."""

    def unless_empty(value: str, before: str, after: str) -> Column:
        text = F.concat(F.lit(before), F.col(value), F.lit(after))
        return F.when(F.coalesce(F.col(value), F.lit("")) != "", text).otherwise("")

    return F.concat(
        F.lit("## "), ordinal.cast("string"), F.lit(" "), emoji(F.col("severity")), F.lit(" "), F.col("title"),
        F.lit("\n\n| severity | rule | place |\n|---|---|---|\n| "), F.col("severity"),
        F.lit(" | "), F.col("rule_id"), F.lit(" | `"), F.col("file_path"), F.lit(":"),
        F.col("start_line").cast("string"), F.lit("` |\n\n"),
        unless_empty("description", "", "\n\n"),
        unless_empty("match", "    ", "\n\n"),
        unless_empty("remediation", "*What to do:* ", "\n\n"),
    )


def table_section(ordinal: Column, verbose: bool = True) -> Column:
    """The plain text of a finding with its number: where and what, then indented what was seen and what to do."""
    place = F.concat(F.col("file_path"), F.lit(" line "), F.col("start_line").cast("string"))
    lines = [
        F.concat(F.lpad(ordinal.cast("string"), 6, " "), F.lit("  "), place),
        F.concat(F.lit("        "), F.lower("severity"), F.lit(" "), F.col("rule_id"), F.lit(": "), F.col("title")),
    ]
    shown = [("about", "description", DESCRIPTION_WIDTH), ("do", "remediation", REMEDIATION_WIDTH)]
    if verbose:
        shown.insert(0, ("seen", "match", MATCH_WIDTH))
    for label, name, width in shown:
        text = F.concat(F.lit(f"        {label:<6}"), truncate(F.col(name), width))
        lines.append(F.when(F.col(name) != "", text))
    return F.concat_ws("\n", *lines, F.lit(""))


def _markdown_head(row, start: dt.datetime, end: dt.datetime) -> str:
    counts = [
        ("targets", row["scanned_targets"]), ("errors", row["errors"]),
        ("findings", row["total_findings"]),
        *((s.lower(), row[f"{s.lower()}_count"]) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")),
        ("duration", f"{(end - start).total_seconds():.3f} s"),
    ]
    table = "\n".join(f"| {name} | {value} |" for name, value in counts)
    tail = "" if row["total_findings"] else "Nothing was found.\n\n"
    return f"# Audit of {start.isoformat()}\n\n| what | how much |\n|---|---|\n{table}\n\n{tail}"


def _table_head(row, shares) -> str:
    width = max(len(str(row["total_findings"])), 1)
    lines = [f"{row['total_findings']} findings in {row['scanned_targets']} targets, {row['errors']} not read whole"]
    for share in shares:
        if share["findings"]:
            lines.append(f"  {share['findings']:>{width}} {share['severity'].lower():<9}{'=' * max(1, share['filled'])}")
    return "\n".join([*lines, CLOSING[row["verdict"]], ""])


def _json_ends(row: dict, start: dt.datetime, end: dt.datetime) -> tuple[str, str]:
    """What stands before and after the results in one JSON document."""
    summary = {k: v for k, v in row.items() if k != "verdict"}
    summary |= {
        "duration": int((end - start) / dt.timedelta(microseconds=1)) * 1000,
        "start_time": start.isoformat(), "end_time": end.isoformat(),
    }
    head = json.dumps({"version": REPORT_VERSION, "timestamp": end.isoformat(), "summary": summary})
    return head.removesuffix("}") + ', "results": [', "]}"


def _single(results: DataFrame, path: str, format: str, row: dict, shares, start: dt.datetime, end: dt.datetime, verbose: bool, root: str) -> None:
    if format == "json":
        head, tail = _json_ends(row, start, end)
        line = json_result(F.col("error"), F.col("findings"))
        write_single(results, path, "path", value=line, head=head, tail=tail, between=",")
        return
    findings = stored(with_rank(unnest(results)), "findings")
    if format in ("sarif", "github"):
        github = format == "github"
        made = sarif.single_result(root, github)
        head, tail = sarif.single_ends(findings, github, start, end)
        write_single(findings, path, *ORDER, value=made, head=head, tail=tail, between=",")
        return
    lines = numbered(unnest(results))
    markdown = format in ("markdown", "md")
    head = _markdown_head(row, start, end) if markdown else _table_head(row, shares)
    section = markdown_section(F.col("ordinal")) if markdown else table_section(F.col("ordinal"), verbose)
    write_single(lines, path, "ordinal", value=section, head=head)


def write_report(
    results: DataFrame,
    path: str,
    format: str = "table",
    mode: str = "intent",
    start: dt.datetime | None = None,
    verbose: bool = True,
    root: str = "",
    size: int = DOCUMENT_SIZE,
    single: bool = False,
) -> None:
    """Write per-target results as a report; an unknown format is a table.

    The results are worked out once and kept in the shared folder while the
    report is made. ``root`` is cut from paths in the format ``github``, and a
    SARIF document of a folder holds at most ``size`` findings. With ``single``
    the report is the file ``path``, whatever its size. Only the summary, one
    row, and the rules that fired pass through the driver.
    """
    start = start or dt.datetime.now(dt.timezone.utc)
    spark = results.sparkSession
    format = format.lower()
    if format == "parquet":
        unnest(results).write.partitionBy("severity").parquet(path)
        return
    results = stored(results, "results")
    end = dt.datetime.now(dt.timezone.utc)
    if single:
        summary = stored(summarize(results, mode).withColumn("verdict", verdict()), "summary")
        shares = severity_share(summary).orderBy("severity_rank").collect()
        _single(results, path, format, summary.first().asDict(), shares, start, end, verbose, root)
        return
    if format in ("sarif", "github"):
        findings = unnest(results).withColumn("report", F.lit("report"))
        groups = spark.createDataFrame([("report",)], "report string")
        if format == "github":
            made = sarif.github_documents(findings, "report", root, size, groups)
        else:
            made = sarif.sarif_documents(findings, "report", size, start, end, groups)
        made.select(F.col("document").alias("value")).write.text(path)
        return
    summary = stored(summarize(results, mode).withColumn("verdict", verdict()), "summary")
    row = summary.first().asDict()
    if format == "json":
        head = spark.createDataFrame([(REPORT_VERSION, end)], "version string, timestamp timestamp")
        totals = F.struct(
            *[F.lit(v).cast("bigint").alias(k) for k, v in row.items() if k != "verdict"],
            F.lit(int((end - start) / dt.timedelta(microseconds=1)) * 1000).cast("bigint").alias("duration"),
            F.lit(start.isoformat()).alias("start_time"),
            F.lit(end.isoformat()).alias("end_time"),
        )
        head = head.withColumn("summary", totals)
        head.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/summary")
        json_rows(results).select("value").write.text(f"{path}/results")
        return
    lines = numbered(unnest(results))
    if format in ("markdown", "md"):
        head, section = _markdown_head(row, start, end), markdown_section(F.col("ordinal"))
    else:
        shares = severity_share(summary).orderBy("severity_rank").collect()
        head, section = _table_head(row, shares), table_section(F.col("ordinal"), verbose)
    opening = spark.createDataFrame([(0, head)], "ordinal bigint, value string")
    body = lines.select("ordinal", section.alias("value"))
    opening.unionByName(body).orderBy("ordinal").select("value").write.text(path)


FORMATS = ("table", "json", "sarif", "github", "markdown", "md", "parquet")
