"""The cases the rules are defined by, and what each mode makes of them."""

from __future__ import annotations

import pytest
from helpers import found, targets
from pyspark.sql import functions as F

from auditlake.config import read_config, size_in_bytes
from auditlake.functions import secrets
from auditlake.model import CONFIG_EXCLUDES, DEFAULT_EXCLUDES, DEFAULT_SEVERITIES, ScanOptions
from auditlake.operators import classify
from auditlake.operators.catalog import (
    builtin_rules,
    catalog,
    custom_rule,
    rules_from_config,
    select_rules,
)
from auditlake.operators.extend import Scanner, find_with
from auditlake.operators.match import find, scan

ACCESS_KEY = "AK" + "IAIOSFODNN7EXAMPLE"
SECRET_KEY = "aws_sec" + 'ret_access_key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"'
GITHUB = '\n\t// token for CI\n\tconst token = "gh' + "p_" + "x" * 36 + '"\n\t'
JWT = "ey" + "J" + "a" * 20 + ".ey" + "J" + "b" * 20 + "." + "c" * 20

ROOT_DOCKERFILE = 'FROM ubuntu:20.04\nRUN apt-get update\nUSER root\nCMD ["./app"]'
LATEST_DOCKERFILE = 'FROM nginx:latest\nCOPY . /app\nCMD ["nginx"]'
POD = (
    "apiVersion: v1\nkind: Pod\nmetadata:\n  name: test-pod\nspec:\n  containers:\n"
    "  - name: test\n    image: nginx\n    securityContext:\n      privileged: true"
)


def ids(spark, rows, **options):
    frame = find(targets(spark, rows), ScanOptions(**options))
    return {(r.rule_id, r.start_line, r.id) for r in frame.collect()}


def test_aws_keys(spark):
    rows = [("a.go", ACCESS_KEY), ("b.go", SECRET_KEY), ("c.go", 'const m = "Hello, World!"')]
    expected = [("a.go", 1, "SEC001"), ("b.go", 1, "SEC002")]
    assert found(spark, rows, entropy=True) == expected


def test_github_token_found_once(spark):
    assert found(spark, [("config.js", GITHUB)], entropy=True) == [("config.js", 3, "SEC003")]


@pytest.mark.parametrize(
    "text, masked",
    [
        ("short", "*****"), (ACCESS_KEY, ACCESS_KEY[:4] + "*" * 12 + "MPLE"),
        ("password123", "pass***123"), ("", ""), ("12345678", "********"),
    ],
)
def test_mask(spark, text, masked):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(F.expr(secrets.mask("t"))).first()[0] == masked


def test_allowlist_is_per_rule(spark):
    rows = [("e.js", f"t = {JWT} // Example"), ("f.js", f"t = {JWT}")]
    assert found(spark, rows) == [("f.js", 1, "SEC013")]


def test_root_user(spark):
    assert ids(spark, [("Dockerfile", ROOT_DOCKERFILE)]) == {
        ("DOCKER009", 1, "8171c85e5352ed45"), ("DOCKER001", 3, "c449f72c0c876cdf"),
    }


def test_latest_tag(spark):
    assert ids(spark, [("Dockerfile", LATEST_DOCKERFILE)]) == {
        ("DOCKER002", 1, "1466443a0b3a00a9"), ("DOCKER009", 1, "8171c85e5352ed45"),
        ("DOCKER012", 1, "6be8851abc43efcb"),
    }


def test_privileged_pod(spark):
    assert ids(spark, [("pod.yaml", POD)]) == {
        ("K8S009", 6, "c56bed82c71153b8"), ("K8S001", 10, "dbea7328836a982c"),
        ("K8S017", 1, "b6a8b9ec7e0e3659"),
    }


def test_is_dockerfile(spark):
    cases = {
        "Dockerfile": True, "dockerfile": True, "Dockerfile.prod": True, "app.dockerfile": True,
        "main.go": False, "docker-compose.yaml": False, "Dockerfile.d/readme.md": True,
    }
    frame = spark.createDataFrame([(p,) for p in cases], "p string")
    got = frame.select("p", classify.is_dockerfile(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_is_manifest(spark):
    cases = [
        ("deployment.yaml", "apiVersion: apps/v1\nkind: Deployment\n", True),
        ("config.yml", "apiVersion: v1\nmetadata:\n", True),
        ("config.yaml", "database:\n  host: localhost", False),
        ("main.go", "apiVersion: v1\nkind: Pod", False),
    ]
    frame = spark.createDataFrame(cases, "p string, c string, e boolean")
    test = classify.is_manifest(F.col("p"), F.col("c")) == F.col("e")
    assert [r[0] for r in frame.select(test).collect()] == [True] * 4


def test_defaults():
    options = ScanOptions()
    assert options.excludes == DEFAULT_EXCLUDES and len(DEFAULT_SEVERITIES) == 4
    with pytest.raises(ValueError, match="no scanners enabled"):
        select_rules(ScanOptions(scanners=("other",)))
    with pytest.raises(ValueError, match="unknown mode"):
        ScanOptions(mode="other")
    assert len(select_rules(ScanOptions(scanners=("SECRETS",)))) == 20


def test_catalog_has_all_rules(spark):
    rows = catalog(spark).groupBy("family").count().collect()
    assert {r[0]: r[1] for r in rows} == {"secret": 20, "docker": 12, "k8s": 17}
    assert len({r.id for r in builtin_rules()}) == 49


def test_dockerfile_that_is_a_manifest(spark):
    """Docker rules win line by line, whole-manifest checks run as well."""
    text = "apiVersion: v1\nkind: Pod\ncontainers:\n  privileged: true\nUSER root\n"
    rules = {r for _, _, r in found(spark, [("dockerfile.yaml", text)])}
    assert rules == {"DOCKER001", "DOCKER009", "K8S016", "K8S017"}


LINES = "FROM a:1\nADD ./a /b\nADD https://x/y /z\nRUN apt-get install -y a\n"
BLOCK = (
    "apiVersion: v1\nkind: Pod\nsecurityContext:\nlimits:\nrunAsNonRoot: true\n"
    "  capabilities:\n    add:\n    - SYS_ADMIN\n  env:\n    valueFrom:\n    - secretKeyRef: a\n"
)


def test_modes_differ_where_they_should(spark):
    rows = [("Dockerfile", LINES), ("b.yaml", BLOCK)]
    intent = set(found(spark, rows))
    reference = set(found(spark, rows, mode="reference"))
    assert intent - reference == {
        ("Dockerfile", 2, "DOCKER004"), ("Dockerfile", 4, "DOCKER007"),
        ("b.yaml", 6, "K8S008"), ("b.yaml", 9, "K8S013"),
    }
    assert reference <= intent


def test_capability_names_are_whole_words_in_intent_mode(spark):
    head = "apiVersion: v1\nkind: Pod\nsecurityContext:\nrunAsNonRoot: true\n"
    rows = [("a.yaml", head + "capabilities: {add: [], allow: 1}\n")]
    assert found(spark, rows) == []
    assert found(spark, rows, mode="reference") == [("a.yaml", 5, "K8S008")]


@pytest.mark.parametrize("port", [0, 22, 80, 999, 1000, 1023, 1024, 8080])
def test_exposed_ports(spark, port):
    text = f"FROM a:1\nUSER a\nHEALTHCHECK CMD b\nEXPOSE {port}\r\n"
    expected = [("Dockerfile", 4, "DOCKER010")] if port < 1000 else []
    assert found(spark, [("Dockerfile", text)]) == expected


@pytest.mark.parametrize(
    "line, rules",
    [
        ("FROM ubuntu", ["DOCKER003"]), ("FROM\tubuntu", []), ("  from ubuntu AS b", ["DOCKER003"]),
        ("FROM reg:5000/a", []), ("FROM $BASE", []), ("FROM scratch", []),
        ("FROM --platform=x a:1", ["DOCKER003"]), ("FROM a:latest AS b", []),
        ("FROM  b:1", []), ("FROM  b", ["DOCKER003"]),
        ("RUN curl -s x | shuf", ["DOCKER006"]), ("RUN sudo a", ["DOCKER011"]),
        ("RUN pseudo a", []), ("RUN ésudo x", ["DOCKER011"]),
        ("ENV A_KEY b", []), ("ENV A_KEY=b", ["DOCKER005"]), ("USER root:root", []),
        ("RUN apt-get install --no-install-recommends a && apt-get install b && apt-get clean",
         ["DOCKER007"]),
        ("RUN apt-get install a && apt-get install --no-install-recommends b && apt-get clean", []),
    ],
)
def test_docker_line_edges(spark, line, rules):
    text = f"{line}\nUSER a\nHEALTHCHECK NONE\n"
    assert [r for _, _, r in found(spark, [("Dockerfile", text)])] == rules


def test_selection(spark):
    rows = [("Dockerfile", ROOT_DOCKERFILE + "\n" + ACCESS_KEY)]
    assert found(spark, rows, enabled_rules=("SEC001",)) == [("Dockerfile", 5, "SEC001")]
    assert ("Dockerfile", 5, "SEC001") not in found(spark, rows, disabled_rules=("SEC001",))
    high = {r for _, _, r in found(spark, rows, severities=("high",))}
    assert high == {"DOCKER001"}
    assert found(spark, rows, enabled_rules=("NONE",)) == []
    assert scan(targets(spark, rows), ScanOptions(enabled_rules=("NONE",))).first().findings == []


def test_selection_in_reference_mode_compares_scanner_names(spark):
    rows = [("Dockerfile", ROOT_DOCKERFILE + "\n" + ACCESS_KEY)]
    every = found(spark, rows, mode="reference")
    assert found(spark, rows, mode="reference", enabled_rules=("SEC001",)) == []
    assert found(spark, rows, mode="reference", disabled_rules=("SEC001",)) == every
    assert found(spark, rows, mode="reference", severities=("low",)) == every
    only = found(spark, rows, mode="reference", enabled_rules=("misconfig-scanner",))
    assert {r for _, _, r in only} == {"DOCKER001", "DOCKER009"}


def test_custom_rules(spark):
    rules = rules_from_config(
        [
            {"id": "C1", "severity": "medium", "pattern": "TODO:|FIXME:", "file_types": ["*.go"]},
            {"id": "C2", "severity": "LOW", "pattern": r"^x\s*$"},
        ]
    ) + (custom_rule("C3", "Docker", "INFO", r"^CMD\b", family="docker"),)
    rows = [("a/a.go", "TODO: b\r\nx\r\n"), ("a.py", "TODO: b\n x\n"), ("Dockerfile", "CMD a\n")]
    enabled = ("C1", "C2", "C3")
    assert found(spark, rows, custom_rules=rules, enabled_rules=enabled) == [
        ("Dockerfile", 1, "C3"), ("a/a.go", 1, "C1"), ("a/a.go", 2, "C2"),
    ]


@pytest.mark.parametrize("pattern", ["(", "a(?!b)", r"(a)\1", "a**", "(?<=a)b"])
def test_invalid_custom_pattern_names_the_rule(pattern):
    with pytest.raises(ValueError, match="rule BAD1"):
        custom_rule("BAD1", "Bad", "LOW", pattern)


def test_more_rules_than_one_word_of_bits(spark):
    rules = tuple(custom_rule(f"N{i:03}", "n", "LOW", f"needle{i:03}") for i in range(150))
    text = "\n".join(f"needle{i:03}" for i in range(0, 150, 7))
    for gate in ("arrow", "builtin", "none"):
        got = found(spark, [("a.txt", text)], custom_rules=rules, gate=gate)
        assert [r for _, _, r in got] == [f"N{i:03}" for i in range(0, 150, 7)]


def test_many_lines_with_capabilities_take_linear_time(spark):
    head = "apiVersion: v1\nkind: Pod\n"
    text = head + "capabilities:\nadd:\n" * 60_000
    rules = {r for _, _, r in found(spark, [("big.yaml", text)])}
    assert "K8S008" not in rules


def test_entropy_rule(spark):
    random = "9f86d081884c7d659a2feaa0c55ad015"
    rows = [
        ("a", f"k = '{random}'"), ("b", "k = '" + "0" * 40 + "'"), ("c", f"k = {random}"),
        ("d", '"' + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + '"'),
    ]
    assert found(spark, rows, entropy=True) == [("a", 1, "SECENT"), ("d", 1, "SECENT")]
    assert found(spark, rows) == []


def test_configuration(spark):
    config = read_config(
        {
            "scan": {"exclude": ["**/test/**"], "max_file_size": "2KB", "follow_symlinks": True},
            "rules": {"disabled": ["SEC014"], "custom": [{"id": "C9", "pattern": "INTERNAL_[A-Z]{4}"}]},
            "output": {"format": "sarif"}, "ci": {"fail_on": "low"},
        }
    )
    options = config.options
    assert (options.excludes, options.max_file_bytes) == (("**/test/**",), 2048)
    assert (config.follow_symlinks, config.format, config.fail_on) == (True, "sarif", "low")
    assert "SEC014" not in {r.id for r in select_rules(options)}
    frame = find(targets(spark, [("a", "INTERNAL_ABCD")]), options)
    assert [(r.rule_id, r.severity) for r in frame.collect()] == [("C9", "MEDIUM")]
    assert read_config({}).options.excludes == CONFIG_EXCLUDES
    with pytest.raises(ValueError, match="not a size"):
        size_in_bytes("ten")


def test_scanners_of_ones_own(spark):
    def nothing(frame):
        return find(frame).limit(0)

    seen = []

    def own(frame):
        seen.append(frame)
        return find(frame, ScanOptions(scanners=("secrets",)))

    rows = targets(spark, [("a", ACCESS_KEY)])
    assert find_with(rows, [Scanner("none", nothing), Scanner("own", own)]).count() == 2
    assert find_with(rows, [Scanner("urls", own, types=("URL",))]).count() == 1
    options = ScanOptions(mode="reference", enabled_rules=("own",))
    assert find_with(rows, [Scanner("none", nothing), Scanner("own", own)], options).count() == 1
    assert len(seen) == 3


def manifest(*lines):
    return "\n".join(("apiVersion: v1", "kind: Pod", "runAsNonRoot: true", "securityContext:", *lines)) + "\n"


@pytest.mark.parametrize("lines, at", [
    (("spec:", "  - a:", "    capabilities:", "      add:", "      - SYS_ADMIN", "  - b:", "    capabilities:", "      add: [NET_ADMIN]"), [7, 11]),
    (("  capabilities:", "    drop: [ALL]", "  x:", "  capabilities:", "    add: [NET_BIND_SERVICE]", "    drop: [ALL]"), []),
    (("  capabilities:", "    drop:", "    - ALL", "    add:", "    - CHOWN", "", "    # more", "    - all"), [5]),
    (("  capabilities: {drop: [ALL], add: [SYS_PTRACE]}", "  capabilities: {drop: [ALL]}"), [5]),
    (("  capabilities:", "    add:", "---", "    - SYS_ADMIN"), []),
    (("  capabilities:", "    add:", "    - SYS_ADMINS"), []),
    (("- capabilities:", "    add:", "      - SYS_ADMIN", "      - NET_ADMIN"), [5]),
])
def test_capabilities_of_every_block(spark, lines, at):
    rows = found(spark, [("a.yaml", manifest(*lines))], enabled_rules=("K8S008",))
    assert [line for _, line, _ in rows] == at


@pytest.mark.parametrize("lines, at", [
    (("  env:", "  - name: A", "    valueFrom:", "      secretKeyRef: {name: a}", "  b:", "  env:", "  - valueFrom: {secretKeyRef: {name: b}}"), [5, 10]),
    (("  env:", "  - name: A", "    valueFrom:", "      configMapKeyRef: {}", "  secretKeyRef:"), []),
    (("  - {env: [{valueFrom: {secretKeyRef: x}}]}",), [5]),
    (("  env:", "  - valueFrom:", "    x: 1", "  - valueFrom:", "      secretKeyRef:", "        name: a"), [5]),
])
def test_secrets_of_every_env_block(spark, lines, at):
    rows = found(spark, [("a.yaml", manifest(*lines))], enabled_rules=("K8S013",))
    assert [line for _, line, _ in rows] == at


def test_entropy_yields_only_to_rules_that_run_and_where_they_overlap(spark):
    token = "q8Z3kP1xV7mN5bT2cR9wL4yH6jD0sF3gA"
    key, other = f'api_key = "{token}"', f'x = "{token[::-1]}"'
    rows = [("a", key), ("b", f"{key} {other}")]
    assert found(spark, rows, entropy=True) == [("a", 1, "SEC014"), ("b", 1, "SEC014"), ("b", 1, "SECENT")]
    off = found(spark, rows, entropy=True, disabled_rules=("SEC014",))
    assert off == [("a", 1, "SECENT"), ("b", 1, "SECENT")]


def test_enrich_keeps_findings_of_rules_the_catalog_lacks(spark):
    from auditlake.operators.catalog import catalog
    from auditlake.operators.summary import enrich

    rule = custom_rule("MINE", "My rule", "LOW", "abc", remediation="do it")
    findings = find(targets(spark, [("a", "abc ghp_" + "a" * 36)]), ScanOptions(custom_rules=(rule,)))
    rows = {r.rule_id: (r.rule_name, r.family) for r in enrich(findings, catalog(spark)).collect()}
    assert rows["MINE"] == ("My rule", None) and rows["SEC003"][1] == "secret"


@pytest.mark.parametrize("pattern, line, fires", [
    (r"\p{Greek}+x", "αβx", True), (r"\P{Greek}x", "αx", False), (r"[\p{Lu}]{2}$", "aBC", True),
    (r"(?i:key)=1", "KEY=1", True), (r"a(?i)s", "aſ", True), (r"(a(?i)b)c", "aBC", False),
    (r"(?i)a(?-i:b)", "AB", False), (r"(?P<n>a)b", "ab", True), (r"^\w+$", "été", False), (r"(?m:^)x$", "x", True),
])
def test_scoped_flags_and_classes_as_re2(spark, pattern, line, fires):
    import pyarrow as pa
    import pyarrow.compute as pc

    assert pc.match_substring_regex(pa.array([line]), pattern)[0].as_py() == fires
    rule = custom_rule("C", "c", "LOW", pattern)
    for gate in ("arrow", "none"):
        assert bool(found(spark, [("a", line)], custom_rules=(rule,), scanners=("secrets",), gate=gate)) == fires


@pytest.mark.parametrize("pattern", [r"\C", r"(?U)a+", r"(?U:a+)", r"a(?=b)"])
def test_refused_patterns_name_the_rule(pattern):
    with pytest.raises(ValueError, match="rule BAD"):
        custom_rule("BAD", "b", "LOW", pattern)


def test_further_matches_of_a_line_are_in_the_metadata(spark):
    keys = ["AK" + "IA" + c * 16 for c in "AB"]
    rows = find(targets(spark, [("a", " ".join(keys)), ("b", keys[0])])).collect()
    metadata = {r.file_path: r.metadata for r in rows}
    assert metadata["a"]["count"] == "2" and len(metadata["a"]["matches"].split()) == 2
    assert "count" not in metadata["b"] and not any(k in str(metadata) for k in keys)
