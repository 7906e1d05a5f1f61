from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.model import ScanOptions
from auditlake.operators.match import find


def targets(spark, rows):
    """Targets from ``(path, content)`` pairs, in one task each."""
    frame = spark.createDataFrame(rows, "path string, content string")
    return frame.select(
        "path", F.lit("FILE").alias("type"), "content",
        F.create_map(F.lit("size"), F.lit("1 B")).alias("metadata"),
    )


def found(spark, rows, **options):
    """Sorted ``(path, line, rule)`` of a scan."""
    frame = find(targets(spark, rows), ScanOptions(**options))
    return sorted((r.file_path, r.start_line, r.rule_id) for r in frame.collect())
