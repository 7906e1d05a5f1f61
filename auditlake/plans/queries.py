"""The registered queries; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import secrets, sql, text
from auditlake.functions.gate import lines_of
from auditlake.functions.session import shared_path
from auditlake.model import FINDING_COLUMNS, REFERENCE, ScanOptions
from auditlake.operators import classify, extend, match, order, paths, summary, suppress
from auditlake.operators.catalog import catalog, custom_rule
from auditlake.operators.extend import ColumnScanner, Scanner, find_with
from auditlake.plans import fixtures
from auditlake.sinks import common, reports, sarif
from auditlake.sources import walk
from auditlake.sources.tables import file_metadata, targets_from_table
from auditlake.sources.tree import read_tree, root_of
from auditlake.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]

SECRETS = ScanOptions(scanners=("secrets",))
MISCONFIG = ScanOptions(scanners=("misconfig",))
SHOWN = ("id", "rule_id", "severity", "type", "file_path", "start_line", "match")


def _counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("findings"))


def _planted(spark, sf_dir):
    return match.find(fixtures.configs(spark, sf_dir), SECRETS)


def _docker(spark, sf_dir, mode="intent"):
    options = ScanOptions(scanners=("misconfig",), mode=mode)
    return match.find(fixtures.dockerfiles(spark, sf_dir), options)


def _k8s(spark, sf_dir, mode="intent"):
    options = ScanOptions(scanners=("misconfig",), mode=mode)
    return match.find(fixtures.manifests(spark, sf_dir), options)


def _results(spark, sf_dir, mode="intent", fields=("rule_id", "severity")):
    return match.scan(fixtures.everything(spark, sf_dir), ScanOptions(mode=mode), fields)


def _all_findings(spark, sf_dir, fields=FINDING_COLUMNS, **options):
    return match.find(fixtures.everything(spark, sf_dir), ScanOptions(**options), fields=fields)


# What the list of rules that fired is made of.
_SEEN = ("id", "rule_id", "title", "severity", "type", "file_path", "start_line")


# --- secrets --------------------------------------------------------------------


def secret_findings_documents(spark, sf_dir):
    options = ScanOptions(scanners=("secrets",), entropy=True)
    return match.find(fixtures.documents(spark, sf_dir), options).select(*SHOWN)


def secret_findings_conversations(spark, sf_dir):
    options = ScanOptions(scanners=("secrets",), entropy=True)
    return match.find(fixtures.conversations(spark, sf_dir), options).select(*SHOWN)


def secret_findings_pages(spark, sf_dir):
    options = ScanOptions(scanners=("secrets",), entropy=True)
    return match.find(fixtures.pages(spark, sf_dir), options).select(*SHOWN)


def secret_planted(spark, sf_dir):
    return _planted(spark, sf_dir).select(*SHOWN)


def secret_masked(spark, sf_dir):
    hidden = F.length(F.regexp_replace("match", r"[^*]", "")).cast("bigint")
    return _planted(spark, sf_dir).select(
        "rule_id", "match", F.length("match").cast("bigint").alias("n_chars"),
        hidden.alias("n_hidden"),
    )


def secret_allowlist(spark, sf_dir):
    options = ScanOptions(scanners=("secrets",), enabled_rules=("SEC013",))
    found = match.find(fixtures.configs(spark, sf_dir), options)
    return found.select("file_path", "start_line")


def entropy_candidates(spark, sf_dir):
    targets = fixtures.documents(spark, sf_dir).filter(sql.rlike("content", secrets.CANDIDATE))
    tokens = match.number_lines(targets).select(
        "path", F.col("line_no").cast("int").alias("line_no"),
        F.explode_outer(F.expr(secrets.candidates("line"))).alias("token"),
    )
    entropy = F.round(F.expr(secrets.shannon_entropy("token")), 6)
    return tokens.filter("token IS NOT NULL").withColumn("entropy", entropy)


# --- misconfiguration -----------------------------------------------------------


def docker_findings(spark, sf_dir):
    return _docker(spark, sf_dir).select(*SHOWN)


def docker_findings_reference(spark, sf_dir):
    return _docker(spark, sf_dir, REFERENCE).select(*SHOWN)


def docker_rule_counts(spark, sf_dir):
    return _counts(_docker(spark, sf_dir), "rule_id")


def k8s_findings(spark, sf_dir):
    return _k8s(spark, sf_dir).select(*SHOWN)


def k8s_findings_reference(spark, sf_dir):
    return _k8s(spark, sf_dir, REFERENCE).select(*SHOWN)


def k8s_rule_counts(spark, sf_dir):
    return _counts(_k8s(spark, sf_dir), "rule_id", "severity")


def k8s_file_checks(spark, sf_dir):
    options = ScanOptions(scanners=("misconfig",), enabled_rules=("K8S014", "K8S016", "K8S017"))
    found = match.find(fixtures.manifests(spark, sf_dir), options)
    return found.select("rule_id", "file_path", "start_line", "match")


# --- catalog and selection --------------------------------------------------------


def custom_rules(spark, sf_dir):
    rules = (
        custom_rule("CUSTOM001", "Mail Address", "low",
                    r"(?i)\b[a-z0-9._-]+@[a-z0-9-]+\.(com|org|net)\b"),
        custom_rule("CUSTOM002", "Connective At Start", "MEDIUM", r"^(The|Die|Le|La|El)\s",
                    file_types=("*.py", "*.go")),
        custom_rule("CUSTOM003", "Long Line", "INFO", line="length(line) > 2000"),
    )
    options = ScanOptions(custom_rules=rules, enabled_rules=tuple(r.id for r in rules))
    return match.find(fixtures.repository(spark, sf_dir), options).select(
        "id", "rule_id", "severity", "file_path", "start_line"
    )


def custom_k8s_rule(spark, sf_dir):
    rule = custom_rule("CUSTOM010", "Bare Pod", "MEDIUM", r"^kind:\s+Pod$", family="k8s")
    options = ScanOptions(custom_rules=(rule,), enabled_rules=(rule.id,))
    return match.find(fixtures.manifests(spark, sf_dir), options).select(*SHOWN)


def _short_texts(targets):
    """A scanner that reports texts of fewer than 200 characters."""
    found = targets.filter(F.length("content") < 200)
    fields = {
        "id": "substring(sha2(concat(path, ':1:SHORT'), 256), 1, 16)", "rule_id": "'SHORT'",
        "title": "'Short Text'", "description": "''", "severity": "'INFO'",
        "type": "'MISCONFIGURATION'", "file_path": "path", "start_line": "1", "end_line": "1",
        "match": "concat(length(content), ' characters')", "remediation": "''",
        "metadata": "map('rule_name', 'Short Text')", "timestamp": "CAST(NULL AS TIMESTAMP)",
    }
    return found.selectExpr(*[f"{value} AS {name}" for name, value in fields.items()])


def extra_scanner(spark, sf_dir):
    options = ScanOptions(scanners=("secrets",), entropy=True)
    scanner = Scanner("short-texts", _short_texts)
    return find_with(fixtures.documents(spark, sf_dir), [scanner], options).select(*SHOWN)


def _short_text_findings(path, content):
    """An own scanner: texts of fewer than 200 characters."""
    found = F.struct(
        F.lit("SHORT").alias("rule_id"), F.lit("Short text").alias("title"), F.lit("INFO").alias("severity"),
        F.lit(1).alias("line_no"), F.concat(F.length(content).cast("string"), F.lit(" characters")).alias("match"),
    )
    return F.when(F.length(content) < 200, F.array(found)).otherwise(F.array())


_WITH_SHORT = ScanOptions(
    scanners=("secrets",), entropy=True, own_scanners=(ColumnScanner("short", _short_text_findings),)
)


def own_scanner(spark, sf_dir):
    """Findings of the built-in rules and of an own scanner, from one pass."""
    return match.find(fixtures.documents(spark, sf_dir), _WITH_SHORT).select(*SHOWN)


def own_scanner_summary(spark, sf_dir):
    """Totals with the findings of an own scanner."""
    results = match.scan(fixtures.documents(spark, sf_dir), _WITH_SHORT, ("severity",))
    return summary.summarize(results).select("total_targets", "total_findings", "info_count")


def own_scanner_stream(spark, sf_dir):
    """The same scanner over a stream of several batches."""
    base = shared_path(spark, "stream")
    rows = _arriving(spark, sf_dir, "documents", base)
    targets = targets_from_table(rows, fixtures.DOCUMENT_PATH, "text")
    found = stream.stream_findings(targets, _WITH_SHORT)
    stream.write_findings(found, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*SHOWN)


def _wide_lines(path: str, content: str):
    """A scanner in Python: lines of more than 400 characters."""
    for number, line in enumerate(lines_of(content), start=1):
        if len(line) > 400:
            yield {"rule_id": "WIDE", "title": "Wide line", "severity": "LOW", "line_no": number, "match": f"{len(line)} characters"}


def python_scanner(spark, sf_dir):
    """Findings of a scanner in Python and of the built-in rules, from one pass, in findings and in totals."""
    options = ScanOptions(scanners=("secrets",), own_scanners=(extend.python_scanner("wide", _wide_lines),))
    targets = fixtures.documents(spark, sf_dir)
    found = match.find(targets, options).select("file_path", "rule_id", "severity", "start_line", "match")
    totals = summary.summarize(match.scan(targets, options, ("severity",)))
    total = totals.select(
        F.lit("all").alias("file_path"), F.lit("TOTAL").alias("rule_id"), F.lit("INFO").alias("severity"),
        F.col("low_count").cast("int").alias("start_line"), F.col("total_findings").cast("string").alias("match"),
    )
    return found.unionByName(total)


def rule_select(spark, sf_dir):
    wanted = ("SEC003", "SEC014", "DOCKER001", "DOCKER007", "K8S008", "K8S016")
    return _counts(_all_findings(spark, sf_dir, ("rule_id",), enabled_rules=wanted), "rule_id")


def rule_disable(spark, sf_dir):
    unwanted = ("SEC014", "DOCKER009", "K8S017")
    return _counts(_all_findings(spark, sf_dir, ("rule_id",), disabled_rules=unwanted), "rule_id")


def severity_filter(spark, sf_dir):
    found = _all_findings(spark, sf_dir, ("rule_id", "severity"), severities=("critical", "high"))
    return _counts(found, "rule_id", "severity")


def rule_catalog(spark, sf_dir):
    counts = _counts(_all_findings(spark, sf_dir, ("rule_id",)), "rule_id")
    listed = catalog(spark).select("rule_id", "severity", "name")
    found = F.coalesce("findings", F.lit(0).cast("bigint")).alias("findings")
    return listed.join(counts, "rule_id", "left").select("rule_id", "severity", "name", found)


def findings_enriched(spark, sf_dir):
    return summary.enrich(_docker(spark, sf_dir), catalog(spark)).select(
        "id", "rule_id", "rule_name", "family"
    )


# --- paths, text and targets --------------------------------------------------------


def lines_numbered(spark, sf_dir):
    lines = match.number_lines(fixtures.documents(spark, sf_dir))
    return lines.select("path", F.col("line_no").cast("int").alias("line_no"), "line")


def classify_targets(spark, sf_dir):
    path, content = F.col("path"), F.col("content")
    return fixtures.everything(spark, sf_dir).select(
        "path",
        classify.is_dockerfile(path).alias("docker"),
        classify.is_manifest(path, content).alias("k8s"),
        classify.rule_family(path, content).alias("family"),
    )


EXCLUDES = ("**/*.min.js", "repo1*/**", "**/test/**")


def path_exclude(spark, sf_dir):
    kept = paths.filter_targets(fixtures.repository(spark, sf_dir), excludes=EXCLUDES)
    return kept.select("path")


def path_exclude_reference(spark, sf_dir):
    globs = ("**/*.min.js", "repo1**", "**/test/**", "repo2/src**/*.py", "*.yaml")
    kept = paths.filter_targets(
        fixtures.repository(spark, sf_dir), excludes=globs, mode=REFERENCE
    )
    return kept.select("path")


def path_include(spark, sf_dir):
    kept = paths.filter_targets(
        fixtures.repository(spark, sf_dir), includes=("*.py", "src/**/*.go", "**/en/*.md")
    )
    return kept.select("path")


def binary_ext_filter(spark, sf_dir):
    targets = fixtures.repository(spark, sf_dir)
    return targets.filter(~paths.is_binary_name(F.col("path"))).select("path")


def size_filter(spark, sf_dir):
    targets = paths.filter_targets(fixtures.repository(spark, sf_dir), max_bytes=4096)
    return targets.select("path", F.octet_length("content").cast("bigint").alias("n_bytes"))


def target_metadata(spark, sf_dir):
    metadata = file_metadata("path", "octet_length(content)")
    return fixtures.repository(spark, sf_dir).select(
        "path", metadata["extension"].alias("extension"), metadata["size"].alias("size")
    )


def oversize_lines(spark, sf_dir):
    results = match.scan(fixtures.long_dockerfiles(spark, sf_dir), MISCONFIG)
    return results.select("path", "error", F.size("findings").cast("bigint").alias("findings"))


# --- results and aggregates -----------------------------------------------------------


def finding_ids(spark, sf_dir):
    return _all_findings(spark, sf_dir, ("file_path", "start_line", "rule_id", "id"))


def scan_summary(spark, sf_dir):
    return summary.summarize(_results(spark, sf_dir, fields=("severity",)))


def scan_summary_reference(spark, sf_dir):
    return summary.summarize(_results(spark, sf_dir, REFERENCE, ("severity",)), REFERENCE)


def per_target_results(spark, sf_dir):
    rules = F.array_sort(F.transform("findings", lambda f: f["rule_id"]))
    return _results(spark, sf_dir).select(
        "path", "error", F.size("findings").cast("bigint").alias("findings"),
        F.concat_ws(",", rules).alias("rules"),
    )


def severity_share(spark, sf_dir):
    return summary.severity_share(summary.summarize(_results(spark, sf_dir, fields=("severity",))))


def fail_gate(spark, sf_dir):
    thresholds = ("critical", "high", "medium", "low", "other")
    return summary.summarize(_results(spark, sf_dir, fields=("severity",))).select(
        *[summary.fails(t).alias(f"fails_{t}") for t in thresholds]
    )


def verdict(spark, sf_dir):
    found = match.scan(fixtures.everything(spark, sf_dir), ScanOptions(entropy=True), ("severity",))
    return summary.summarize(found).select(
        "total_findings", summary.verdict().alias("verdict")
    )


def rules_seen(spark, sf_dir):
    return summary.rules_seen(_all_findings(spark, sf_dir, _SEEN))


def findings_ranked(spark, sf_dir):
    return order.numbered(_docker(spark, sf_dir)).select(
        "ordinal", "severity_rank", "file_path", "start_line", "rule_id"
    )


# --- reports ----------------------------------------------------------------------------


def truncate_text(spark, sf_dir):
    lines = match.number_lines(fixtures.documents(spark, sf_dir))
    return lines.select(
        "path", F.col("line_no").cast("int").alias("line_no"),
        text.truncate(F.col("line"), common.MATCH_WIDTH).alias("short"),
    )


def _from_json(column: str, **fields: str) -> list:
    return [F.get_json_object(column, p).alias(name) for name, p in fields.items()]


def sarif_results(spark, sf_dir):
    found = _k8s(spark, sf_dir)
    finding = F.struct(*[F.col(c) for c in found.columns if c != "metadata"])
    rows = found.select(F.to_json(sarif.result(finding)).alias("result"))
    place = "$.locations[0].physicalLocation"
    return rows.select(
        *_from_json(
            "result", rule_id="$.ruleId", level="$.level",
            fingerprint="$.fingerprints.primaryLocationLineHash",
            uri=f"{place}.artifactLocation.uri", start_line=f"{place}.region.startLine",
            snippet=f"{place}.region.snippet.text",
        )
    )


def sarif_github(spark, sf_dir):
    found = _k8s(spark, sf_dir)
    finding = F.struct(*[F.col(c) for c in found.columns if c != "metadata"])
    rows = found.select(F.to_json(sarif.github_result(finding, "k8s")).alias("result"))
    place = "$.locations[0].physicalLocation"
    return rows.select(
        *_from_json(
            "result", rule_id="$.ruleId", level="$.level",
            uri=f"{place}.artifactLocation.uri", start_line=f"{place}.region.startLine",
            snippet=f"{place}.region.snippet", fingerprint="$.fingerprints",
        )
    )


def sarif_rules(spark, sf_dir):
    seen = summary.rules_seen(_all_findings(spark, sf_dir, _SEEN))
    return seen.select(
        "rule_id", F.col("title").alias("name"), sarif.level(F.col("severity")).alias("level"),
        sarif.help_uri(F.col("rule_id")).alias("help_uri"),
    )


def _grouped_documents(spark, sf_dir):
    fields = tuple(c for c in FINDING_COLUMNS if c != "metadata")
    found = _all_findings(spark, sf_dir, fields).withColumn(
        "project", F.substring_index("file_path", "/", 1)
    )
    return sarif.sarif_documents(found, "project")


def sarif_documents(spark, sf_dir):
    parsed = sarif.validate(_grouped_documents(spark, sf_dir))
    results = F.aggregate(
        "parsed.runs", F.lit(0), lambda n, r: n + F.size(r["results"])
    )
    return parsed.groupBy("project").agg(
        F.bool_and("valid").alias("valid"),
        F.sum("findings").alias("findings"),
        F.sum(results).alias("results"),
    )


def json_rows(spark, sf_dir):
    rows = reports.json_rows(_results(spark, sf_dir, fields=FINDING_COLUMNS))
    shape = "array<struct<id:string,start_line:int,match:string>>"
    found = F.coalesce(F.from_json(F.get_json_object("value", "$.findings"), shape), F.array().cast(shape))
    ordered = rows.withColumn("found", F.array_sort(found))
    total = F.aggregate("found", F.lit(0).cast("bigint"), lambda n, f: n + f["start_line"])
    return ordered.select(
        *_from_json(
            "value", path="$.target.path", type="$.target.type", size="$.target.metadata.size",
            error="$.error",
        ),
        F.col("value").contains('"findings":null').alias("no_findings"),
        F.size("found").cast("bigint").alias("findings"),
        F.concat_ws(",", F.transform("found", lambda f: f["id"])).alias("ids"),
        F.concat_ws("|", F.transform("found", lambda f: f["match"])).alias("matches"),
        total.alias("lines"),
    )


def markdown_rows(spark, sf_dir):
    rows = order.numbered(_docker(spark, sf_dir))
    section = F.split(reports.markdown_section(F.col("ordinal")), "\n")
    return rows.select("ordinal", section[0].alias("heading"), section[4].alias("facts"))


def table_rows(spark, sf_dir):
    rows = order.numbered(_docker(spark, sf_dir))
    block = F.split(reports.table_section(F.col("ordinal")), "\n")
    return rows.select(
        "ordinal", block[0].alias("place_line"), block[1].alias("rule_line"), block[2].alias("match_line"),
    )


def report_file(spark, sf_dir):
    """All results as one JSON document in one file, read back line by line: one line holds one result."""
    path = shared_path(spark, "report")
    results = match.scan(fixtures.configs(spark, sf_dir), SECRETS)
    reports.write_report(results, f"{path}/report.json", "json", single=True)
    lines = spark.read.text(f"{path}/report.json")
    schema = "target STRUCT<path: STRING>, findings ARRAY<STRUCT<id: STRING, rule_id: STRING>>"
    found = F.from_json(F.regexp_replace("value", "^,", ""), schema)
    ends = F.col("value").startswith('{"version"') | (F.col("value") == "]}")
    read = lines.filter(~ends).select(found.alias("r"))
    return read.select(F.col("r.target.path").alias("path"), F.inline_outer("r.findings"))


def _two_reports(spark, sf_dir):
    def report(found):
        return sarif.sarif_documents(found.withColumn("report", F.lit("r")), "report", size=500)

    return report(_docker(spark, sf_dir)), report(_planted(spark, sf_dir))


_RUN_RULES = "array<struct<results:array<struct<ruleId:string>>>>"


def _rules_of_runs(documents):
    """The rule of each result of all runs of SARIF documents."""
    runs = F.from_json(F.get_json_object("document", "$.runs"), _RUN_RULES)
    results = documents.select(F.explode(runs).alias("run")).select(F.explode("run.results").alias("r"))
    return results.select(F.col("r.ruleId").alias("rule_id"))


def merge_reports(spark, sf_dir):
    merged = sarif.merge_reports(*_two_reports(spark, sf_dir))
    runs = merged.select(F.concat(F.lit('{"runs":['), "run", F.lit("]}")).alias("document"))
    return _counts(_rules_of_runs(runs), "rule_id")


def sarif_merged(spark, sf_dir):
    """Findings per rule in documents that hold all runs of two reports."""
    merged = sarif.merged_documents(*_two_reports(spark, sf_dir))
    return _counts(_rules_of_runs(sarif.validate(merged).filter("valid")), "rule_id")


def sarif_clean(spark, sf_dir):
    """A document for every kind of device file, also where nothing is found."""
    targets = fixtures.dockerfiles(spark, sf_dir)
    kind = F.element_at(F.split("path", "/"), -1).alias("kind")
    options = ScanOptions(scanners=("misconfig",), enabled_rules=("DOCKER012",))
    found = match.find(targets.filter("path LIKE '%prod'"), options)
    named = found.withColumn("kind", F.element_at(F.split("file_path", "/"), -1))
    made = sarif.sarif_documents(named, "kind", groups=targets.select(kind))
    return sarif.validate(made).groupBy("kind").agg(
        F.bool_and("valid").alias("valid"), F.sum("findings").cast("bigint").alias("findings")
    )


def github_documents(spark, sf_dir):
    """Results, places and levels in the documents for GitHub, cut at 400 findings."""
    found = _k8s(spark, sf_dir).withColumn("report", F.lit("r"))
    made = sarif.github_documents(found, "report", "k8s", size=400)
    shape = (
        "array<struct<results:array<struct<ruleId:string,level:string,locations:array<struct<"
        "physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
    )
    runs = F.from_json(F.get_json_object("document", "$.runs"), shape)
    rows = made.select("chunk", F.explode(runs[0]["results"]).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(
        "chunk", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"),
        place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"),
    )


def written_report(spark, sf_dir):
    """A JSON report written and read back: its rows with findings."""
    path = shared_path(spark, "report")
    results = match.scan(fixtures.configs(spark, sf_dir), SECRETS)
    reports.write_report(results, f"{path}/json", "json")
    rows = spark.read.text(f"{path}/json/results")
    found = F.from_json(F.get_json_object("value", "$.findings"), "array<struct<id:string,rule_id:string>>")
    listed = rows.select(F.get_json_object("value", "$.target.path").alias("path"), F.explode(found).alias("f"))
    return listed.select("path", "f.id", "f.rule_id")


def written_findings(spark, sf_dir):
    """The findings table, written by severity and read back."""
    path = shared_path(spark, "report")
    reports.write_report(match.scan(fixtures.configs(spark, sf_dir), SECRETS), f"{path}/f", "parquet")
    return spark.read.parquet(f"{path}/f").select(*SHOWN)


def scan_counters(spark, sf_dir):
    """What a scan counts while its results are written, and its rate."""
    path = shared_path(spark, "counted")
    results = match.scan(fixtures.long_dockerfiles(spark, sf_dir), MISCONFIG, ("severity",))
    counted, observation = summary.observe_counts(results)
    counted.write.mode("overwrite").parquet(path)
    seen = observation.get
    totals = spark.read.parquet(path).agg(F.count("*").alias("total")).select(
        "total", F.lit(seen["processed"]).cast("bigint").alias("processed"),
        F.lit(seen["errors"]).cast("bigint").alias("errors"),
    )
    rate, share = summary.progress(F.col("processed"), F.col("total"), F.lit(2.0))
    return totals.withColumns({"rate": rate, "percentage": share})


def target_types(spark, sf_dir):
    """Targets of other types than files have no findings, empty ones neither."""
    targets = fixtures.configs(spark, sf_dir)
    number = F.regexp_extract("path", "[0-9]+", 0).cast("int")
    mixed = targets.withColumns({
        "type": F.when(number % 3 == 0, "URL").otherwise(F.col("type")),
        "content": F.when(number % 5 == 0, "").otherwise(F.col("content")),
    })
    return match.find(mixed, SECRETS).select(*SHOWN)


def repaired_texts(spark, sf_dir):
    """Texts whose bytes are not all UTF-8 are repaired and read."""
    rows = fixtures.rows_of(spark, sf_dir, "customer")
    body = f"concat(unhex('FFE941'), encode({fixtures.SECRET_CONTENT}, 'UTF-8'))"
    targets = targets_from_table(rows, fixtures.SECRET_PATH, body)
    return match.find(targets, SECRETS).select(*SHOWN)


def suppressed(spark, sf_dir):
    """Findings of every customer's file, with a list of exceptions that grows with the table."""
    rows = fixtures.rows_of(spark, sf_dir, "customer")
    found = match.find(fixtures.configs(spark, sf_dir), SECRETS)
    exact = found.filter(F.pmod(F.regexp_extract("file_path", "[0-9]+", 0).cast("int"), F.lit(4)) == 0)
    exceptions = exact.selectExpr("id AS fingerprint", "CAST(NULL AS STRING) AS rule_id", "CAST(NULL AS STRING) AS path_glob")
    globs = rows.selectExpr(
        "CAST(NULL AS STRING) AS fingerprint", "CASE WHEN c_custkey % 2 = 0 THEN 'SEC007' END AS rule_id",
        """CASE c_custkey % 5 WHEN 0 THEN concat('cfg/', c_custkey, '.conf') WHEN 1 THEN concat('**/', c_custkey, '.conf')
           WHEN 2 THEN concat('cfg/', c_custkey, '*') WHEN 3 THEN 'src/**' ELSE concat('*.', c_custkey) END AS path_glob""",
    )
    listed = exceptions.unionByName(globs).selectExpr("*", "'known' AS reason", "CAST(NULL AS DATE) AS until")
    return suppress.marked(found, listed).select("id", "rule_id", "file_path", "suppressed")


def many_rules(spark, sf_dir):
    """Five hundred rules of one's own over every document, together with the built-in ones for secrets."""
    own = tuple(
        custom_rule(f"OWN{i:03d}", f"Word {i}", "LOW", rf"\b(id-{i:03d}-|token_{i:03d}[:=])[a-z]+") for i in range(500)
    )
    # Each document names some of the rules.
    named = "concat(coalesce(text, ''), chr(10), 'id-', lpad(CAST(doc_id * 7 % 640 AS STRING), 3, '0'), '-x')"
    targets = targets_from_table(fixtures.table(spark, sf_dir, "documents"), fixtures.DOCUMENT_PATH, named)
    found = match.find(targets, ScanOptions(scanners=("secrets",), custom_rules=own))
    return _counts(found.filter(F.col("rule_id").startswith("OWN")), "rule_id")


# --- files and streams ----------------------------------------------------------------------


def _written_tree(spark, sf_dir, docs="docs", conf="conf"):
    """Texts of two tables as files below two folders of a new one."""
    root = shared_path(spark, "tree")
    for name, targets in (
        (docs, fixtures.documents(spark, sf_dir)), (conf, fixtures.configs(spark, sf_dir))
    ):
        targets.select("content").write.option("maxRecordsPerFile", 64).text(f"{root}/{name}")
    return root


def _tree_counts(spark, roots, **options):
    """Findings per folder and rule; files hold many texts, so their size is not limited here."""
    options = ScanOptions(scanners=("secrets",), entropy=True, max_file_bytes=1 << 40, **options)
    found = match.find(read_tree(spark, roots, options), options)
    project = F.translate(F.element_at(F.split("file_path", "/"), -2), "._", "")
    return _counts(found.withColumn("project", project), "project", "rule_id")


def scan_tree(spark, sf_dir):
    root = _written_tree(spark, sf_dir)
    return _tree_counts(spark, root.removeprefix("file:"), excludes=("*.crc",))


def tree_address(spark, sf_dir):
    """The same by the address of the store."""
    return _tree_counts(spark, _written_tree(spark, sf_dir), excludes=("*.crc",))


def tree_hidden(spark, sf_dir):
    """Folders whose names begin with a dot or an underscore are read."""
    root = _written_tree(spark, sf_dir, "_docs", ".conf")
    return _tree_counts(spark, root.removeprefix("file:"), excludes=("*.crc",))


def tree_globs(spark, sf_dir):
    """Globs go by the path below the root."""
    root = _written_tree(spark, sf_dir).removeprefix("file:")
    return _tree_counts(spark, root, excludes=("*.crc", "docs/**"), includes=("conf/**", "docs/**"))


def multiple_roots(spark, sf_dir):
    """Roots are appended, one given twice counts twice."""
    root = _written_tree(spark, sf_dir).removeprefix("file:")
    return _tree_counts(spark, [root, f"{root}/conf"], excludes=("*.crc",))


def tree_wide(spark, sf_dir):
    """A folder of one file per document and a deep chain of folders."""
    root = fixtures.file_tree(spark, sf_dir).removeprefix("file:")
    options = ScanOptions(scanners=("secrets",), entropy=True, includes=("wide/**", "deep/**"), excludes=(), max_file_bytes=1 << 40)
    found = match.find(read_tree(spark, root, options), options)
    # The root's own name: an address may spell what stands before it with more slashes than paths have.
    below = F.substring_index("file_path", f"/{root.rpartition('/')[2]}/", -1)
    top = F.element_at(F.split(below, "/"), 1)
    return _counts(found.withColumn("project", top), "project", "rule_id")


def tree_pruned(spark, sf_dir):
    """What a walk enters, cuts off and finds, in both modes."""
    root = fixtures.file_tree(spark, sf_dir).removeprefix("file:")
    chosen = {
        "intent": ScanOptions(excludes=("**/skip/**",), includes=("deep/**", "wide/*.txt", "old*/**")),
        REFERENCE: ScanOptions(mode=REFERENCE, excludes=(f"{root}/other**",)),
    }
    counted = [
        walk.counts(walk.walk(spark, root_of(root, options))).select(F.lit(mode).alias("mode"), "kind", "entries")
        for mode, options in chosen.items()
    ]
    return counted[0].unionByName(counted[1])


# Batches that a table arrives in.
BATCHES = 4


def _in_batches(rows, base):
    """Rows as a stream of several batches, from files written to a shared folder: one a core for each batch."""
    files = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(BATCHES * files).write.mode("overwrite").parquet(f"{base}/in")
    return stream.stream_table(rows.sparkSession, f"{base}/in", rows.schema, files_per_trigger=files)


def _arriving(spark, sf_dir, table, base):
    """Rows of a table as a stream of several batches, a file each, in the order they are written."""
    rows = fixtures.table(spark, sf_dir, table)
    rows.repartition(BATCHES).write.mode("overwrite").parquet(f"{base}/in")
    return stream.stream_table(spark, f"{base}/in", rows.schema, files_per_trigger=1)


def _customer_stream(spark, sf_dir, base):
    rows = _arriving(spark, sf_dir, "customer", base).repartition(2 * spark.sparkContext.defaultParallelism)
    return targets_from_table(rows, fixtures.SECRET_PATH, fixtures.SECRET_CONTENT)


def stream_scan(spark, sf_dir):
    base = shared_path(spark, "stream")
    found = stream.stream_findings(_customer_stream(spark, sf_dir, base), SECRETS)
    stream.write_findings(found, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*SHOWN)


def stream_counts(spark, sf_dir):
    base = shared_path(spark, "stream")
    found = stream.stream_findings(_customer_stream(spark, sf_dir, base), SECRETS)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    counts = stream.running_counts(found)
    stream.write_counts(counts, save, f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_dedup(spark, sf_dir):
    """Every event brings the same file of its user, with a token; each finding is kept once.

    The events arrive within a month, in any order, so a span of that length forgets none early.
    """
    base = shared_path(spark, "stream")
    rows = _arriving(spark, sf_dir, "events", base)
    token = "concat('gh', 'p_', repeat(lpad(CAST(user_id AS STRING), 9, '0'), 4))"
    targets = targets_from_table(
        rows.withColumn("arrival", F.col("ts").cast("timestamp")),
        "concat('user/', CAST(user_id AS STRING))", f"concat('token: ', {token})", keep=("arrival",),
    )
    found = stream.stream_findings(targets, SECRETS, carry=("arrival",))
    kept = stream.drop_repeats(found, "arrival", "31 days")
    stream.write_findings(kept, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("file_path", "id", "match")


def stream_summary(spark, sf_dir):
    """Totals of all targets, kept while they arrive in four batches."""
    base = shared_path(spark, "stream")
    arriving = _in_batches(fixtures.everything(spark, sf_dir), base)
    results = match.scan(arriving, ScanOptions(), ("severity",))
    stream.write_summary(results, f"{base}/totals", f"{base}/state").awaitTermination()
    return stream.read_summary(spark, f"{base}/totals")


def stream_tree(spark, sf_dir):
    """Findings of a tree read as a stream: in two runs, with hidden files added between them, and a third that adds nothing."""
    base = shared_path(spark, "stream")
    root, log = f"{base}/tree", f"{base}/log"
    rows = fixtures.rows_of(spark, sf_dir, "customer")
    hidden = "concat('.', CAST(c_custkey % 9 AS STRING), '/', CAST(c_custkey AS STRING), '/.env')"
    files = rows.selectExpr("c_custkey", f"{hidden} AS path", f"{fixtures.SECRET_CONTENT} AS content")
    for part in ("c_custkey % 2 = 0", "c_custkey % 2 = 1", "c_custkey < 0"):
        fixtures.write_files(files.filter(part), root)
        stream.extend_log(spark, root, log)
        found = stream.stream_findings(stream.stream_tree(spark, root, log), SECRETS)
        stream.write_findings(found, f"{base}/out", f"{base}/state").awaitTermination()
    key = F.element_at(F.split("file_path", "/"), -2).cast("bigint")
    return spark.read.parquet(f"{base}/out").select(key.alias("c_custkey"), "rule_id", "start_line", "match")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        secret_findings_documents, secret_findings_conversations, secret_findings_pages,
        secret_planted, secret_masked, secret_allowlist, entropy_candidates,
        docker_findings, docker_findings_reference, docker_rule_counts,
        k8s_findings, k8s_findings_reference, k8s_rule_counts, k8s_file_checks,
        custom_rules, custom_k8s_rule, extra_scanner, own_scanner,
        own_scanner_summary, own_scanner_stream, rule_select, rule_disable, severity_filter,
        rule_catalog, findings_enriched, lines_numbered, classify_targets,
        path_exclude, path_exclude_reference, path_include, binary_ext_filter, size_filter,
        target_metadata, oversize_lines, finding_ids, scan_summary, scan_summary_reference,
        per_target_results, severity_share, fail_gate, verdict, rules_seen, findings_ranked,
        truncate_text, sarif_results, sarif_github, sarif_rules, sarif_documents, json_rows,
        markdown_rows, table_rows, report_file, merge_reports, sarif_merged, sarif_clean, github_documents,
        written_report, written_findings, scan_counters, target_types, repaired_texts, scan_tree,
        tree_address, tree_hidden, tree_globs, multiple_roots, tree_wide, tree_pruned, stream_scan, stream_counts,
        stream_dedup, stream_summary, stream_tree, suppressed, many_rules, python_scanner,
    )
}
