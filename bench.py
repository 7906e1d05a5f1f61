"""Time the headline queries; prints one line of JSON.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of cores. Every
query writes all its rows and columns to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from auditlake.model import ScanOptions
from auditlake.operators import match
from auditlake.plans import fixtures
from auditlake.plans.queries import QUERIES

HEADLINES = (
    "secret_findings_documents", "secret_findings_pages", "secret_planted", "docker_findings",
    "k8s_findings", "scan_summary", "per_target_results", "rules_seen", "findings_ranked",
    "sarif_documents", "json_rows", "custom_rules", "path_exclude", "lines_numbered",
    "scan_tree", "stream_scan",
)

# The texts are doubled this often, so that fixed costs do not hide the gates.
GATE_COPIES = 4


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("auditlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Each test table is one row group; one core would read it alone.
        .config(fixtures.PARTITIONS, cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in HEADLINES:
        for times in (cold, warm):
            begin = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            times[name] = round(time.perf_counter() - begin, 3)
    # Gates on the same texts, spread over all cores and read from memory.
    texts = fixtures.documents(spark, sf_dir).repartition(int(cpus))
    for _ in range(GATE_COPIES):
        texts = texts.union(texts)
    texts = texts.cache()
    n_bytes = texts.selectExpr("sum(octet_length(content))").first()[0]
    gates: dict[str, float] = {}
    for gate in ("arrow", "builtin", "none"):
        options = ScanOptions(scanners=("secrets",), gate=gate)
        for _ in range(2):
            begin = time.perf_counter()
            run(match.find(texts, options))
            seconds = time.perf_counter() - begin
        gates[gate] = round(n_bytes / seconds / 1e6, 1)
    print(
        json.dumps(
            {
                "metric": "total warm time of headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "secret_scan_mb_per_sec": gates,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
