"""Aggregates over results and findings.

Every aggregate combines on the map side down to one row, or one row per
severity or rule, before anything is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from auditlake.model import FINDING_COLUMNS, INTENT, REFERENCE, SEVERITIES

SUMMARY_COLUMNS = (
    "total_targets", "scanned_targets", "errors", "total_findings",
    "critical_count", "high_count", "medium_count", "low_count", "info_count",
)


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def summarize(results: DataFrame, mode: str = INTENT) -> DataFrame:
    """One row of totals over per-target results; zeros when there are none.

    Reference mode leaves the findings of targets with an error out of the
    counts. Intent mode counts every finding that a report shows.
    """
    failed = F.col("error").isNotNull()
    counted = ~failed if mode == REFERENCE else F.lit(True)

    def having(severity: str | None) -> Column:
        found = F.col("findings")
        if severity:
            found = F.filter(found, lambda f: f["severity"] == severity)
        return _total(F.when(counted, F.size(found)).otherwise(0))

    return results.agg(
        F.count("*").alias("total_targets"),
        _total((~failed).cast("int")).alias("scanned_targets"),
        _total(failed.cast("int")).alias("errors"),
        having(None).alias("total_findings"),
        *[having(s).alias(f"{s.lower()}_count") for s in SEVERITIES],
    )


def severity_share(summary: DataFrame, width: int = 40) -> DataFrame:
    """Count of each severity and its share of all findings in ``width`` steps."""
    rows = summary.select(
        "total_findings",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("severity_rank"),
                        F.lit(s).alias("severity"),
                        F.col(f"{s.lower()}_count").alias("findings"),
                    )
                    for i, s in enumerate(SEVERITIES)
                ]
            )
        ).alias("s"),
    )
    share = F.expr(f"s.findings * {width} div total_findings")
    return rows.select(
        "s.severity_rank",
        "s.severity",
        "s.findings",
        F.when(F.col("total_findings") > 0, share).otherwise(0).cast("bigint").alias("filled"),
    )


def fails(threshold: str) -> Column:
    """Whether a summary row is at or over a threshold; unknown ones never are."""
    counts = {"critical": 1, "high": 2, "medium": 3}
    threshold = threshold.lower()
    if threshold == "low":
        return F.col("total_findings") > F.col("info_count")
    test = F.lit(False)
    for severity in SEVERITIES[: counts.get(threshold, 0)]:
        test = test | (F.col(f"{severity.lower()}_count") > 0)
    return test


def verdict() -> Column:
    """What a summary row calls for: ``fix``, ``consider``, ``low_only`` or ``clean``."""
    return (
        F.when(F.col("total_findings") == 0, "clean")
        .when((F.col("critical_count") > 0) | (F.col("high_count") > 0), "fix")
        .when(F.col("medium_count") > 0, "consider")
        .otherwise("low_only")
    )


def rules_seen(findings: DataFrame) -> DataFrame:
    """The rules that fired, how often, and the first finding of each by place."""
    place = F.struct("file_path", "start_line", "id")
    first = F.min_by(F.struct("title", "severity", "type", *place_columns()), place)
    grouped = findings.groupBy("rule_id").agg(
        F.count("*").alias("findings"), first.alias("first")
    )
    return grouped.select(
        "rule_id",
        "findings",
        "first.title",
        "first.severity",
        "first.type",
        F.col("first.file_path").alias("first_path"),
        F.col("first.start_line").alias("first_line"),
    )


def place_columns() -> tuple[str, ...]:
    return ("file_path", "start_line")


def enrich(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings with the name, family and remediation of their rule.

    A finding of a rule that the catalog lacks, such as one of an own scanner,
    stays, with its own title and remediation and no family. The catalog is a
    list held on the driver, one row per rule, so sending it to every task is
    bounded by the number of rules.
    """
    rules = catalog.select(
        "rule_id", F.col("name").alias("_name"), "family", F.col("remediation").alias("_advice")
    )
    joined = findings.join(F.broadcast(rules), "rule_id", "left")
    return joined.withColumns({
        "rule_name": F.coalesce("_name", "title"), "advice": F.coalesce("_advice", "remediation"),
    }).drop("_name", "_advice")


def observe_counts(results: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """Results that count processed targets and errors while they are written."""
    observation = Observation(name)
    counted = results.observe(
        observation,
        F.count("*").alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return counted, observation


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """Items per second (zero without time) and percentage (100 of nothing)."""
    rate = F.when(seconds == 0, 0.0).otherwise(done / seconds)
    percentage = F.when(total == 0, 100.0).otherwise(done / total * 100)
    return rate, percentage


def unnest(results: DataFrame) -> DataFrame:
    """The findings of per-target results, one row each."""
    rows = results.select(F.inline_outer("findings"))
    return rows.filter(F.col("id").isNotNull()).select(*FINDING_COLUMNS)
