"""Exceptions as a table: by fingerprint, rule and glob."""

from __future__ import annotations

import datetime as dt
import itertools
import re

from pyspark.sql import functions as F

from auditlake.functions.prune import _compiled
from auditlake.functions.regex import glob_pattern
from auditlake.operators import suppress

GLOBS = ("src/**", "src/*.py", "**/test/**", "*.env", ".env", "src/a/b.py", "**", "a?b/*.c", "doc", "*.tar.gz", "[ab]/x", "bad[", "**/x.*", "src/**/b.py", "x*")
PATHS = (".env", "src/a.py", "src/a/b.py", "src/test/x.py", "p/q.env", "a1b/z.c", "doc/r.md", "p/doc/r.md", "w.tar.gz", "a/x", "deep/x.y", "x.env/in", "xyz/k", "", None)


def make(spark, rows, exceptions):
    found = spark.createDataFrame(rows, "id string, rule_id string, file_path string")
    held = spark.createDataFrame(exceptions, suppress.SCHEMA)
    return suppress.marked(found.withColumn("reason2", F.lit(1)), held, F.lit(dt.date(2026, 1, 1)))


def test_globs_and_rules_equal_trying_each(spark):
    rows = [(f"f{i}", rule, path) for i, (rule, path) in enumerate(itertools.product(("R1", "R2"), PATHS))]
    exceptions = [(None, rule, glob, f"{rule} {glob}", None) for glob in GLOBS[:5] + GLOBS[7:] for rule in ("R1",) if glob != "**"]
    exceptions += [(None, None, "src/a/b.py", "any", None), (None, None, "src/a/b.py", "twice", None), (None, "R2", "x*", None, None)]

    def covers(exception, rule, path):
        _, wanted, glob, _, _ = exception
        java = glob_pattern(glob)
        return wanted in (None, rule) and path is not None and java is not None and _compiled(java).search(path)

    got = {r.id: r.suppressed for r in make(spark, rows, exceptions).collect()}
    assert got == {i: any(covers(e, rule, path) for e in exceptions) for i, rule, path in rows}
    assert len(set(got.values())) == 2


def test_fingerprints_days_and_what_names_nothing(spark):
    rows = [("f1", "R1", "a"), ("f1", "R1", "a"), ("f2", "R1", "b"), ("f3", "R2", "b"), ("f4", "R3", None), ("f5", "R4", "b")]
    day = dt.date(2026, 1, 1)
    exceptions = [
        ("f1", None, None, "seen", day), ("f2", None, None, "old", dt.date(2025, 12, 31)), (None, None, None, "nothing", None),
        (None, "R3", None, None, None), (None, "R4", "bad[", "malformed", None), ("f1", None, None, "again", None),
    ]
    found = make(spark, rows, exceptions)
    assert found.columns == ["id", "rule_id", "file_path", "reason2", "suppressed", "reason"]
    got = sorted((r.id, r.suppressed, r.reason) for r in found.collect())
    assert got == [("f1", True, "again"), ("f1", True, "again"), ("f2", False, None), ("f3", False, None), ("f4", True, ""), ("f5", False, None)]
    none = make(spark, rows, [])
    assert none.filter("suppressed").count() == 0
    assert make(spark, [], exceptions).count() == 0


def test_a_glob_that_fixes_nothing_covers_all(spark):
    rows = [("f1", "R1", "a/b"), ("f2", "R2", "c")]
    assert make(spark, rows, [(None, None, "**", "all", None)]).filter("suppressed").count() == 2
    assert [r.id for r in make(spark, rows, [(None, "R2", "**", "r", None)]).filter("suppressed").collect()] == ["f2"]


def test_no_cross_join(spark):
    plan = make(spark, [("f", "R", "a")], [(None, None, "a", "x", None)])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_globs_are_filed_under_the_longest_text_they_fix():
    keys = {
        "cfg/12*": "in:cfg/12", "src/**": "in:src/", "a/**/123.conf": "named:123.conf", "*.env": "ending:env", "src/a/b.py": "in:src/a/b.py",
        "a/[x/y]z.c": "in:a/", "**": "", "x*": "", "doc": "named:doc", "a?b/*.c": "in:a", "a?b/*.cc": "ending:cc",
    }
    assert {g: suppress.filed_under(g) for g in keys} == keys


def test_many_globs_of_one_folder_meet_few_findings(spark):
    """Globs that share a folder and differ after it are not all tried on every finding there."""
    rows = [(f"f{i}", "R1", f"cfg/{i:04d}.conf") for i in range(1000)]
    exceptions = [(None, None, f"cfg/{i:04d}*", f"e{i}", None) for i in range(0, 1000, 2)]
    got = make(spark, rows, exceptions)
    assert sorted(r.id for r in got.filter("suppressed").collect()) == sorted(f"f{i}" for i in range(0, 1000, 2))
    found = spark.createDataFrame(rows, "id string, rule_id string, file_path string")
    filed = suppress._filed(spark.createDataFrame(exceptions, suppress.SCHEMA), F.current_date())
    keyed = found.select(F.explode(suppress._looked_up(F.col("file_path"), F.col("rule_id"), F.array(F.lit(8)))).alias("_key"))
    assert keyed.join(filed, "_key").count() == 500


def test_no_list_goes_through_the_driver(spark):
    """Not even where Spark takes the tables for small, by the column their texts are made of."""
    found = spark.range(2000).selectExpr("concat('f', id) AS id", "'R1' AS rule_id", "concat('cfg/', id, '.conf') AS file_path")
    listed = spark.range(1000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN concat('f', id) END AS fingerprint", "CAST(NULL AS STRING) AS rule_id",
        "CASE WHEN id % 2 = 1 THEN concat('cfg/', id, '.*') END AS path_glob", "'known' AS reason", "CAST(NULL AS DATE) AS until",
    )
    got = suppress.marked(found, listed)
    plan = got._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()
    assert got.filter("suppressed").count() == 1000
    rows = got.collect()
    assert "Broadcast" not in plan.toString() and len(rows) == 2000
