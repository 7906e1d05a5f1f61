"""Aggregates, order and report formats."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from helpers import targets
from pyspark.sql import functions as F

from auditlake.model import ScanOptions
from auditlake.operators import order, summary
from auditlake.operators.match import find, scan
from auditlake.operators.summary import unnest
from auditlake.plans import fixtures
from auditlake.sinks import reports, sarif

SF = "/root/testdata/sf0.001"
KEY = "AK" + "IA" + "D" * 16


def results_of(spark, severities, errors=()):
    rows = [(str(i), None if i not in errors else "e", [(s,) for s in group])
            for i, group in enumerate(severities)]
    return spark.createDataFrame(
        rows, "path string, error string, findings array<struct<severity:string>>"
    )


def test_summary(spark):
    results = results_of(spark, [["CRITICAL", "HIGH", "MEDIUM"], ["LOW", "INFO"]])
    row = summary.summarize(results).first()
    assert (row.total_targets, row.total_findings) == (2, 5)
    assert row[4:] == (1, 1, 1, 1, 1)


def test_errored_targets_in_both_modes(spark):
    results = results_of(spark, [["HIGH"], ["HIGH", "LOW"]], errors=(1,))
    intent = summary.summarize(results).first()
    reference = summary.summarize(results, "reference").first()
    assert (intent.errors, intent.scanned_targets, intent.total_findings) == (1, 1, 3)
    assert (reference.errors, reference.total_findings, reference.low_count) == (1, 1, 0)


@pytest.mark.parametrize(
    "severities, verdict, failing",
    [
        ([], "clean", ""), (["INFO"], "low_only", ""), (["LOW"], "low_only", "low"),
        (["MEDIUM"], "consider", "medium low"), (["HIGH"], "fix", "high medium low"),
        (["CRITICAL"], "fix", "critical high medium low"),
    ],
)
def test_gate_and_verdict(spark, severities, verdict, failing):
    row = summary.summarize(results_of(spark, [severities])).select(
        summary.verdict().alias("v"),
        *[summary.fails(t).alias(t) for t in ("critical", "HIGH", "medium", "low", "x")],
    ).first()
    assert row.v == verdict
    assert [t for t in ("critical", "HIGH", "medium", "low", "x") if row[t]] == [
        "HIGH" if t == "high" else t for t in failing.split()
    ]


def test_share_and_progress(spark):
    shares = summary.severity_share(summary.summarize(results_of(spark, [["HIGH", "LOW", "LOW"]])))
    assert {r.severity: r.filled for r in shares.collect()} == {
        "CRITICAL": 0, "HIGH": 13, "MEDIUM": 0, "LOW": 26, "INFO": 0,
    }
    none = summary.severity_share(summary.summarize(results_of(spark, [])))
    assert {r.filled for r in none.collect()} == {0}
    frame = spark.createDataFrame([(5, 10, 2.0), (0, 0, 0.0)], "d int, t int, s double")
    rate, share = summary.progress(F.col("d"), F.col("t"), F.col("s"))
    assert [tuple(r) for r in frame.select(rate, share).collect()] == [(2.5, 50.0), (0.0, 100.0)]


def test_observed_counts(spark):
    rows = [("Dockerfile", "x" * 70_000), ("a", KEY)]
    counted, observation = summary.observe_counts(scan(targets(spark, rows)))
    counted.write.format("noop").mode("overwrite").save()
    assert observation.get == {"processed": 2, "errors": 1}


def test_targets_that_share_a_path_stay_apart(spark):
    rows = [("a", KEY), ("a", f"{KEY}\n{KEY}"), ("a", "")]
    sizes = sorted(len(r.findings) for r in scan(targets(spark, rows)).collect())
    assert sizes == [0, 1, 2]


def test_numbers_and_documents_of_a_hot_group(spark):
    """One path with most findings, and copies of one row, are numbered and kept whole."""
    rows = [("hot/a", "\n".join([KEY] * 3000))] * 3 + [(f"cold{i}/b", KEY) for i in range(50)]
    found = find(targets(spark, rows))
    numbered = order.numbered(found)
    numbers = [r.ordinal for r in numbered.orderBy("ordinal").select("ordinal").collect()]
    assert numbers == list(range(1, 9051))
    group = found.withColumn("project", F.substring_index("file_path", "/", 1))
    documents = sarif.sarif_documents(group, "project", size=1000).collect()
    assert sum(d.findings for d in documents) == 9050 == sum(
        len(json.loads(d.document)["runs"][0]["results"]) for d in documents
    )
    assert sorted(d.findings for d in documents if d.project == "hot") == [1000] * 9
    assert {d.chunks for d in documents if d.project == "hot"} == {9}
    assert len({d.project for d in documents}) == 51
    ranks = [r.severity_rank for r in order.ordered(found).collect()]
    assert ranks == sorted(ranks)


def test_validate(spark):
    frame = spark.createDataFrame(
        [('{"version":"2.1.0","runs":[]}',), ("{",), ('{"a":1}',)], "document string"
    )
    assert [r.valid for r in sarif.validate(frame).collect()] == [True, False, False]


@pytest.mark.parametrize(
    "path, below", [("/r/a/b", "a/b"), ("/r\\a", "a"), ("/r//a", "/a"), ("/x/a", "/x/a"), ("/rs", "s")]
)
def test_relative_path(spark, path, below):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(sarif.relative_path(F.col("p"), "/r")).first()[0] == below


def text_of(folder):
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join(open(os.path.join(folder, p), encoding="utf-8").read() for p in parts)


def test_written_reports(spark, tmp_path):
    rows = [("Dockerfile", "FROM a\nUSER root\n" + KEY), ("b\\c.txt", KEY), ("clean", "x")]
    start = dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc)
    stored = str(tmp_path / "results")
    scan(targets(spark, rows), ScanOptions(scan_time=start)).write.parquet(stored)
    results = spark.read.parquet(stored)
    n = summary.unnest(results).count()

    reports.write_report(results, str(tmp_path / "md"), "MD", start=start)
    markdown = text_of(tmp_path / "md")
    assert markdown.startswith("# Audit of 2026-01-02") and markdown.count("\n## ") == n
    assert "## 1 🔴 AWS Access Key ID" in markdown and "| info" not in markdown
    assert "| duration | " in markdown

    reports.write_report(results, str(tmp_path / "table"), "other")
    table = text_of(tmp_path / "table")
    assert table.startswith(f"{n} findings in ") and f"\n{n:>6}  " in table
    assert " critical =" in table and "Critical or high findings" in table

    reports.write_report(results, str(tmp_path / "json"), "json", start=start)
    head = json.loads(text_of(tmp_path / "json" / "summary"))
    assert head["summary"]["total_findings"] == n and head["version"] == "1.0.0"
    assert head["summary"]["duration"] > 0 and head["summary"]["start_time"].startswith("2026-01-02")
    lines = [json.loads(l) for l in text_of(tmp_path / "json" / "results").splitlines()]
    clean = [l for l in lines if l["target"]["path"] == "clean"][0]
    assert clean["findings"] is None and "content" not in clean["target"]

    reports.write_report(results, str(tmp_path / "sarif"), "sarif", start=start)
    runs = [json.loads(l)["runs"][0] for l in text_of(tmp_path / "sarif").splitlines()]
    assert sum(len(r["results"]) for r in runs) == n
    uris = {x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]
            for r in runs for x in r["results"]}
    assert uris == {"Dockerfile", "b/c.txt"}
    assert runs[0]["invocations"][0]["startTimeUtc"].startswith("2026-01-02")

    driver = runs[0]["tool"]["driver"]
    assert driver["fullName"] and driver["organization"]
    reports.write_report(results, str(tmp_path / "github"), "github", root="b", size=2)
    runs = [json.loads(l)["runs"][0] for l in text_of(tmp_path / "github").splitlines()]
    assert [len(r["results"]) for r in runs].count(2) >= n // 2 and sum(len(r["results"]) for r in runs) == n

    reports.write_report(results, str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == n


def test_report_of_nothing(spark, tmp_path):
    results = scan(targets(spark, [("a", "x")]))
    reports.write_report(results, str(tmp_path / "md"), "markdown")
    assert "Nothing was found" in text_of(tmp_path / "md")
    reports.write_report(results, str(tmp_path / "sarif"), "sarif")
    assert json.loads(text_of(tmp_path / "sarif"))["runs"][0]["results"] == []


@pytest.mark.parametrize("format", ["json", "sarif", "github", "markdown", "table"])
def test_one_report_in_one_file(spark, tmp_path, format):
    results = scan(fixtures.everything(spark, SF), ScanOptions())
    path = tmp_path / f"report.{format}"
    path.write_text("an older report")
    reports.write_report(results, str(path), format, single=True, root="svc")
    text = path.read_text()
    found = sorted(r.id for r in unnest(results).select("id").collect())
    if format == "json":
        whole = json.loads(text)
        assert [r["target"]["path"] for r in whole["results"]] == sorted(r.path for r in results.select("path").collect())
        assert sorted(f["id"] for r in whole["results"] for f in r["findings"] or ()) == found
        assert whole["summary"]["total_findings"] == len(found)
    elif format in ("sarif", "github"):
        (held,) = json.loads(text)["runs"]
        assert len(held["results"]) == len(found)
        rules = [r["id"] for r in held["tool"]["driver"]["rules"]]
        assert sorted(rules) == rules and set(rules) == {r["ruleId"] for r in held["results"]}
        if format == "sarif":
            assert sorted(r["fingerprints"]["primaryLocationLineHash"] for r in held["results"]) == found
            frame = spark.createDataFrame([(text,)], "document string")
            assert sarif.validate(frame).first()["valid"]
    else:
        mark = "## " if format == "markdown" else "        seen  "
        assert sum(line.startswith(mark) for line in text.splitlines()) >= len(found) * 0.9
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".parts")]


def test_a_report_of_nothing_in_one_file(spark, tmp_path):
    results = scan(fixtures.everything(spark, SF).limit(0), ScanOptions())
    for format in ("json", "sarif"):
        reports.write_report(results, str(tmp_path / format), format, single=True)
    assert json.loads((tmp_path / "json").read_text())["results"] == []
    assert json.loads((tmp_path / "sarif").read_text())["runs"][0]["results"] == []


def test_runs_are_merged_in_the_order_of_their_text_by_short_keys(spark):
    """Ranges are chosen by what differs after the common head, not by whole runs, which the driver would gather."""
    from pyspark.sql import functions as F

    from auditlake.sinks import sarif

    long = "x" * 2_000
    runs = [f'{{"tool":"{t}","results":[{{"ruleId":"{r:03d}{e}"}}]}}' for t in ("a" * 3_000, "a" * 2_999, "b") for r in range(30, 0, -1) for e in ("", long, long + "y")]
    runs += [runs[0], '{"tool":"a"}', '{"tool":"b"}']
    document = spark.createDataFrame([('{"runs":[' + r + "]}",) for r in runs], "document string")
    made = sarif.merged_documents(document, runs=50).orderBy("chunk").collect()
    assert [m.runs for m in made] == [50] * (len(runs) // 50) + [len(runs) % 50]
    assert ",".join(m.document.partition('"runs":[')[2].removesuffix("]}") for m in made) == ",".join(sorted(runs))
    rows = spark.createDataFrame([(r,) for r in runs], "run string")
    plan = sarif._in_text_order(rows)._jdf.queryExecution().executedPlan().toString()
    ranges = [line for line in plan.splitlines() if "rangepartitioning(" in line]
    assert ranges and not any("run#" in line.partition("rangepartitioning(")[2].partition(")")[0] for line in ranges)


def test_rules_of_a_run_are_compared_flat_and_keep_their_order(spark):
    rows = targets(spark, [("Dockerfile", "FROM a:latest\nUSER root\nUSER root\n"), ("a/Dockerfile", "USER root\n")])
    kept = find(rows).select("rule_id", "title", "description", "severity", "type", "remediation", "file_path", "start_line", "id", "end_line", "match")
    gathered = kept.agg(F.sort_array(F.collect_list(F.struct(*kept.columns))).alias("fs"))
    fs = F.col("fs")
    shown = gathered.select(
        sarif.run(fs)["tool"]["driver"]["rules"].alias("rules"),
        F.array_distinct(F.transform(fs, lambda f: sarif.rule(f))).alias("nested"),
        sarif.github_run(fs, "")["tool"]["driver"]["rules"].alias("short"),
        F.array_distinct(F.transform(fs, lambda f: sarif.rule(f, True))).alias("nested_short"),
    )
    row = shown.first()
    assert row.rules == row.nested and len(row.rules) > 2 and row.short == row.nested_short
    tool = gathered.select(sarif.run(fs)["tool"].alias("tool"))
    assert "array_distinct(transform(array_distinct(" in tool._jdf.queryExecution().analyzed().toString()
