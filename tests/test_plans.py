"""Plans: one narrow pass, pruned reads, the same findings for every gate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditlake.model import ScanOptions
from auditlake.operators import match
from auditlake.operators.catalog import builtin_rules
from auditlake.plans import fixtures
from auditlake.sources.tables import targets_from_table

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def everything(spark):
    return fixtures.everything(spark, SF)


def test_findings_need_no_shuffle_and_one_gate(spark):
    rows = fixtures.table(spark, SF, "documents")
    text = plan(match.find(targets_from_table(rows, fixtures.DOCUMENT_PATH, "text")))
    assert "Exchange" not in text and text.count("FileScan") == 1
    assert text.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "PushedFilters: []" in text  # a text that is null has no findings, but is a target


def test_misconfiguration_scans_gate_only_files_of_a_kind(spark):
    text = plan(match.find(everything(spark), ScanOptions(scanners=("misconfig",))))
    for part in text.split("ArrowEvalPython")[1:]:
        assert "Filter" in part.split("ArrowEvalPython")[0] and "docker" in part


def test_a_summary_exchanges_no_texts(spark):
    from auditlake.operators.summary import summarize

    text = plan(summarize(match.scan(everything(spark), fields=("severity",))))
    assert "RoundRobin" not in text and text.count("Exchange") == 1


def test_builtin_gate_has_no_python(spark):
    text = plan(match.find(everything(spark), ScanOptions(gate="builtin")))
    assert "EvalPython" not in text


@pytest.mark.parametrize("gate", ["builtin", "none"])
@pytest.mark.parametrize("mode", ["intent", "reference"])
def test_gates_and_results_agree(spark, gate, mode):
    from auditlake.operators.summary import unnest

    def ids(frame):
        return sorted((r.id, r.match) for r in frame.select("id", "match").collect())

    options = ScanOptions(mode=mode, entropy=True)
    expected = ids(match.find(everything(spark), options))
    other = ScanOptions(mode=mode, entropy=True, gate=gate)
    assert ids(match.find(everything(spark), other)) == expected
    assert ids(unnest(match.scan(everything(spark), options))) == expected


def test_each_rule_alone_finds_the_same(spark):
    """All rules together against a plain filter per pattern over all lines."""
    targets = fixtures.union_targets(fixtures.configs(spark, SF), fixtures.documents(spark, SF))
    targets = targets.cache()
    lines = match.number_lines(targets).cache()
    rules = [r for r in builtin_rules() if r.family == "secret"]
    counts = {r[0]: r[1] for r in match.find(targets).groupBy("rule_id").count().collect()}
    for rule in rules:
        assert lines.filter(rule.line_condition).count() == counts.get(rule.id, 0), rule.id


def test_unsupported_types_are_not_scanned(spark):
    key = "AK" + "IA" + "E" * 16
    frame = spark.createDataFrame(
        [("a", "FILE", key, {}), ("b", "URL", key, {}), ("c", "FILE", None, {})],
        "path string, type string, content string, metadata map<string,string>",
    )
    assert [r.file_path for r in match.find(frame).collect()] == ["a"]
    assert match.scan(frame).count() == 3


def test_an_own_scanner_shares_the_pass(spark):
    from auditlake.plans.queries import _WITH_SHORT

    text = plan(match.find(fixtures.documents(spark, SF), _WITH_SHORT))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_a_python_scanner_shares_the_pass(spark):
    from auditlake.operators.extend import python_scanner
    from auditlake.operators.summary import unnest

    def find(path, content):
        yield {"rule_id": "P", "title": "t", "severity": "LOW", "line_no": 1, "match": f"{path} {len(content)}", "remediation": "r"}

    frame = spark.createDataFrame(
        [("a", "FILE", "x"), ("b", "URL", "y"), ("c", "FILE", None), ("d", "FILE", "AK" + "IA" + "E" * 16)],
        "path string, type string, content string",
    )
    options = ScanOptions(own_scanners=(python_scanner("p", find),))
    got = sorted((r.file_path, r.rule_id, r.match, r.remediation) for r in match.find(frame, options).filter("rule_id = 'P'").collect())
    assert got == [("a", "P", "a 1", "r"), ("d", "P", "d 20", "r")]
    assert unnest(match.scan(frame.withColumn("metadata", F.create_map()), options)).count() == 3
    text = plan(match.find(fixtures.documents(spark, SF), options))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_keys_are_dealt_to_all_cores_and_streams_to_several_files(spark, tmp_path):
    from auditlake.plans import fixtures
    from auditlake.plans.queries import BATCHES, _customer_stream, _in_batches

    spark.range(1000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    cores = spark.sparkContext.defaultParallelism
    made = fixtures.configs(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= cores
    assert made.select("path").distinct().count() == 1000
    arriving = _customer_stream(spark, str(tmp_path), str(tmp_path / "files"))
    plan = arriving._jdf.queryExecution().analyzed().toString()
    assert f"Repartition {2 * cores}, true" in plan
    _in_batches(spark.read.parquet(str(tmp_path / "customer.parquet")), str(tmp_path / "base"))
    assert len(list((tmp_path / "base" / "in").glob("part-*"))) == BATCHES * cores
    assert spark.read.parquet(str(tmp_path / "base" / "in")).distinct().count() == 1000


def test_lines_of_kind_rules_are_found_by_the_gate():
    located = [match.Matcher().rules[i].id for i in match.Matcher()._located]
    assert {"DOCKER001", "DOCKER010", "K8S001", "K8S015", "SEC001"} <= set(located)
    assert not {"DOCKER008", "K8S008", "K8S017"} & set(located)


def test_findings_with_some_fields_are_those_with_all(spark):
    fields = ("rule_id", "start_line")
    every = match.find(everything(spark))
    some = match.find(everything(spark), fields=fields)
    assert some.columns == list(fields)
    assert sorted(some.collect()) == sorted(every.select(*fields).collect())
    assert "sha2" not in plan(some) and "sha2" in plan(every)
