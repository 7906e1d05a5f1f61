"""Streams give what batches give, and a restart adds nothing."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from auditlake.model import ScanOptions
from auditlake.operators.match import find, scan
from auditlake.operators.summary import summarize
from auditlake.plans import fixtures
from auditlake.sources.tables import targets_from_table
from auditlake.streaming import stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = fixtures.table(spark, SF, "customer")
    rows.repartition(4).write.parquet(source)

    def start():
        table = stream.stream_table(spark, source, rows.schema, files_per_trigger=1)
        targets = targets_from_table(table, fixtures.SECRET_PATH, fixtures.SECRET_CONTENT)
        found = stream.stream_findings(targets, ScanOptions())
        stream.write_findings(found, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").select("id").collect())

    batch = sorted(
        r.id for r in find(fixtures.configs(spark, SF), ScanOptions()).select("id").collect()
    )
    assert start() == batch and start() == batch
    rows.limit(20).write.mode("append").parquet(source)
    assert len(start()) > len(batch)


def test_repeats_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame(
        [("x", "2026-01-01 00:00:00"), ("x", "2026-01-01 00:01:00"), ("y", "2026-01-01 00:00:30")],
        "id string, at string",
    ).select("id", F.col("at").cast("timestamp").alias("at"))
    rows.write.parquet(source)
    table = stream.stream_table(spark, source, rows.schema)
    kept = stream.drop_repeats(table, "at", "1 hour")
    stream.write_findings(kept, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x", "y"]


def test_totals_survive_crashes_and_replays(spark, tmp_path):
    results = scan(fixtures.everything(spark, SF), fields=("severity",))
    parts = [results.filter(F.pmod(F.hash("path"), F.lit(6)) == i) for i in range(6)]
    folder = str(tmp_path / "totals")
    assert set(stream.read_summary(spark, folder).first()) == {0}
    for i, part in enumerate(parts):
        stream.add_totals(summarize(part), i, folder)
        if i == 3:
            # Once more, as after a crash that came when the table was written but not yet known to be.
            stream.add_totals(summarize(part), i, folder)
    # A table that is not whole does not count, and the one before it does.
    os.makedirs(f"{folder}/batch=9")
    assert stream.read_summary(spark, folder).first() == summarize(results).first()
    assert len([n for n in os.listdir(folder) if n.startswith("batch=")]) <= stream.KEPT + 3


def test_a_streamed_summary_starts_again_where_it_was(spark, tmp_path):
    targets = fixtures.configs(spark, SF)
    targets.repartition(3).write.parquet(f"{tmp_path}/in")

    def run():
        arriving = stream.stream_table(spark, f"{tmp_path}/in", targets.schema, files_per_trigger=1)
        stream.write_summary(scan(arriving, fields=("severity",)), f"{tmp_path}/totals", f"{tmp_path}/state").awaitTermination()
        return stream.read_summary(spark, f"{tmp_path}/totals").first()

    assert run() == run() == summarize(scan(targets)).first()
    targets.limit(10).write.mode("append").parquet(f"{tmp_path}/in")
    assert run()["total_targets"] == targets.count() + 10


def test_a_tree_is_streamed_once(spark, tmp_path):
    root, log = tmp_path / "tree", str(tmp_path / "log")
    key = "AK" + "IA" + "F" * 16

    def put(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    def run():
        added = stream.extend_log(spark, str(root), log)
        found = stream.stream_findings(stream.stream_tree(spark, str(root), log))
        stream.write_findings(found, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        return added, sorted((os.path.relpath(r.file_path, root), r.start_line) for r in rows)

    put(".env", key)
    put("a/.hidden/b", f"x\n{key}")
    put("vendor/c", key)
    assert run() == (2, [(".env", 1), ("a/.hidden/b", 2)])
    assert run() == (0, [(".env", 1), ("a/.hidden/b", 2)])
    put("late/.env", key)
    put(".env", f"\n\n{key} changed")
    assert run() == (2, [(".env", 1), (".env", 3), ("a/.hidden/b", 2), ("late/.env", 1)])
