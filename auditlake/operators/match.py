"""The match operator: targets to findings in one narrow pass.

A target goes through these steps inside one stage, without a shuffle:

1. classify it from its path and text;
2. tell from the whole text which rules may fire (``functions.gate``);
3. find the lines of the patterns that may fire, in the gate's own pass (RE2,
   in time proportional to the text);
4. for all other rules split the text of the few targets left into numbered
   lines, and try each rule that may fire on those lines, or once on the text;
5. build the findings from the rule's fixed fields, a constant array.

The findings of a target are gathered from its own row, so nothing is grouped
and targets that share a path stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import gate, regex, secrets, text
from auditlake.functions.sql import quote, rlike
from auditlake.model import FILE, FINDING_COLUMNS, INTENT, LONG_LINE_ERROR, REFERENCE, ScanOptions
from auditlake.operators import classify
from auditlake.operators.catalog import (
    ENTROPY_RULE,
    WHOLE_MANIFEST,
    Rule,
    builtin_rules,
    contains_guards,
    select_rules,
)

BUILTIN = frozenset(builtin_rules(INTENT) + builtin_rules(REFERENCE))
_NO_HITS = (
    "CAST(array() AS ARRAY<STRUCT<rule:INT,line_no:INT,match:STRING,every:ARRAY<STRING>>>)"
)

NO_TEXTS = "CAST(array() AS ARRAY<STRING>)"
# A field that tells a finding from the empty row of a target without any.
_MADE = "_made"


def finding_id(path: str, line: str, rule_id: str) -> str:
    """SQL text for sixteen hex digits that identify a rule at a line of a file."""
    return f"substring(sha2(concat_ws(':', {path}, {line}, {rule_id}), 256), 1, 16)"


class Matcher:
    """The rules of one scan, compiled to columns."""

    def __init__(self, options: ScanOptions | None = None, rules: Sequence[Rule] | None = None):
        self.options = options or ScanOptions()
        self.rules = tuple(select_rules(self.options) if rules is None else rules)
        self.families = {r.family for r in self.rules}

    @property
    def _only_kinds(self) -> bool:
        """Whether all rules are for files of a kind, so that other texts need no gate."""
        return self.families <= {"docker", "k8s"}

    # --- rules located by the gate ---------------------------------------------

    @property
    def _located(self) -> list[int]:
        """Rules whose lines and matches the gate itself finds."""
        if self.options.gate != "arrow":
            return []
        return [
            i for i, r in enumerate(self.rules)
            if not r.file_types and not r.when
            and (r.id == ENTROPY_RULE.id or r.pattern is not None and self._text_pattern(r) is not None)
        ]

    def _located_specs(self) -> tuple[list[gate.Located], gate.Blanked | None]:
        specs, blanked = [], None
        for i in self._located:
            rule = self.rules[i]
            if rule.id == ENTROPY_RULE.id:
                named = [r for r in self.rules if r.family == "secret" and r.pattern]
                if self.options.mode == REFERENCE:
                    named = [r for r in builtin_rules(REFERENCE) if r.family == "secret"]
                others = []
                for cleared in (False, True):
                    group = [r for r in named if bool(r.unless) == cleared]
                    if group:
                        every, unless = ("|".join(f"(?:{p})" for p in x if p) for x in zip(*((r.pattern, r.unless) for r in group), strict=True))
                        others.append((every, unless or None))
                blanked = gate.Blanked(i, secrets.CANDIDATE, tuple(others))
            else:
                specs.append(gate.Located(i, rule.pattern, rule.match == "masked", rule.match in ("trimmed", "raw") or rule.unless is not None))
        return specs, blanked

    def _found_hits(self, wanted: Sequence[str]) -> str:
        """SQL array of hits from what the gate has found."""
        found = "found"
        of_kinds = [str(i) for i in self._located if self.rules[i].family in ("docker", "k8s")]
        if of_kinds and self._readable:
            found = f"filter({found}, f -> error IS NULL OR f.rule NOT IN ({', '.join(of_kinds)}))"
        groups: dict[str, list[int]] = {}
        for i in self._located:
            rule = self.rules[i]
            groups.setdefault(rule.match, []).append(i)
            if rule.id == ENTROPY_RULE.id:
                some = secrets.random_ones("f.matches")
                kept = f"named_struct('rule', f.rule, 'line_no', f.line_no, 'matches', {some}, 'line', f.line)"
                found = f"filter(transform({found}, f -> CASE WHEN f.rule = {i} THEN {kept} ELSE f END), f -> f.rule <> {i} OR size(f.matches) > 0)"
            if rule.unless:
                found = f"filter({found}, f -> NOT (f.rule = {i} AND {rlike('f.line', rule.unless)}))"
        if not groups:
            return _NO_HITS
        shown = {"masked": secrets.mask("get(f.matches, 0)"), "trimmed": text.trim_space_sql("f.line"), "raw": "f.line"}
        cases = " ".join(f"WHEN f.rule IN ({', '.join(map(str, of))}) THEN {shown.get(kind, quote(kind))}" for kind, of in groups.items())
        match = f"CASE {cases} END" if "match" in wanted else "''"
        every = NO_TEXTS
        if "metadata" in wanted:
            every = f"transform(coalesce(f.matches, {NO_TEXTS}), m -> {secrets.mask('m')})"
        hit = f"named_struct('rule', f.rule, 'line_no', f.line_no, 'match', {match}, 'every', {every})"
        return f"CASE WHEN scanned THEN transform({found}, f -> {hit}) ELSE {_NO_HITS} END"

    # --- whole targets -------------------------------------------------------

    def _metadata(self, targets: DataFrame) -> tuple[str, ...]:
        wanted = self.options.max_line_bytes is not None and "metadata" in targets.columns
        return ("metadata",) if wanted else ()

    @property
    def _readable(self) -> str:
        """SQL text added to the conditions of rules that skip files with an error."""
        return " AND error IS NULL" if self.options.mode == REFERENCE else ""

    def _classified(self, targets: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Targets with ``docker``, ``k8s`` and ``error``."""
        path, content = F.col("path"), F.col("content")
        scanned = (F.col("type") == FILE) & (F.octet_length(content) > 0)
        docker = k8s = F.lit(False)
        if self.families & {"docker", "k8s"}:
            docker = F.coalesce(scanned & classify.is_dockerfile(path), F.lit(False))
            k8s = F.coalesce(scanned & classify.is_manifest(path, content), F.lit(False))
        kinds = targets.select(
            "path", "content", *dict.fromkeys((*keep, *self._metadata(targets))),
            F.coalesce(scanned, F.lit(False)).alias("scanned"),
            docker.alias("docker"), k8s.alias("k8s"),
        )
        error = F.lit(None).cast("string")
        if self.options.max_line_bytes is not None:
            too_long = text.has_long_line(content, self.options.max_line_bytes)
            if "metadata" in targets.columns:
                given = F.try_element_at("metadata", F.lit(text.LONGEST_LINE)).cast("bigint")
                too_long = F.coalesce(given >= self.options.max_line_bytes, too_long)
            error = F.when((F.col("docker") | F.col("k8s")) & too_long, F.lit(LONG_LINE_ERROR))
        return kinds.withColumn("error", error)

    def _gated(self, kinds: DataFrame) -> DataFrame:
        """Targets with ``may_fire``, the bits of the rules that may fire."""
        always, patterns, conditions = 0, [], []
        for i, rule in enumerate(self.rules):
            kind = rule.family if rule.family in ("docker", "k8s") else ""
            pattern = self._text_pattern(rule)
            if pattern is None or self.options.gate == "none":
                always |= 1 << i
            elif self.options.gate == "arrow":
                patterns.append((i, kind, pattern))
            elif kind:
                always |= 1 << i
            else:
                tests = contains_guards("content", rule.guards) + [rlike("content", pattern)]
                conditions.append((i, " AND ".join(tests)))
        size = len(self.rules)
        if patterns:
            kind = F.expr("CASE WHEN docker THEN 'docker' WHEN k8s THEN 'k8s' END")
            content = F.when(F.expr("docker OR k8s" if self._only_kinds else "scanned"), F.col("content"))
            gated = kinds.withColumn("_gate", gate.arrow_gate(patterns, always, size, *self._located_specs())(content, kind))
            return gated.withColumns({"may_fire": F.col("_gate.bits"), "found": F.col("_gate.found")}).drop("_gate")
        return kinds.withColumn("may_fire", gate.builtin_gate(conditions, always, size))

    @staticmethod
    def _text_pattern(rule: Rule) -> str | None:
        """A pattern that matches any text with a line the rule fires on."""
        if rule.pattern is None:
            return rule.gate
        if rule.family == "custom" and rule.file_types:
            return None
        if not regex.anchored(rule.pattern):
            return rule.pattern
        # White space before the end takes up a carriage return as well.
        ended = rule.pattern.count("$") == 1 and rule.pattern.endswith(r"\s*$")
        started = rule.pattern.replace("(?i)", "").startswith("^")
        if not regex.anchored(rule.pattern.removesuffix("$").replace("^", "", 1)):
            if (ended or "$" not in rule.pattern) and started:
                return f"(?m){rule.pattern}"
        return None

    # --- hits ----------------------------------------------------------------

    def _applies(self, rule: Rule) -> str:
        """SQL condition on the file: the rule is to be tried on it."""
        tests = []
        if rule.family == "docker":
            tests.append(f"docker{self._readable}")
        elif rule.id in WHOLE_MANIFEST:
            tests.append(f"k8s{self._readable}")
        elif rule.family == "k8s":
            tests.append(f"k8s AND NOT docker{self._readable}")
        else:
            tests.append("scanned")
        if rule.file_types:
            globs = (regex.glob_pattern(g, ancestors=False) for g in rule.file_types)
            base = "substring_index(path, '/', -1)"
            named = [f"{base} RLIKE {quote(g)}" for g in globs if g]
            tests.append("(" + " OR ".join(named or ["false"]) + ")")
        return " AND ".join(tests)

    def _tried(self) -> str:
        """SQL condition on the file: its lines are to be looked at, by other means than the gate."""
        tests = [f"(docker OR k8s){self._readable}"] if self.families & {"docker", "k8s"} else []
        words: dict[int, int] = {}
        located = set(self._located)
        for i, rule in enumerate(self.rules):
            if rule.family in ("docker", "k8s") or i in located:
                continue
            if rule.file_types:
                tests.append(f"{self._applies(rule)} AND {gate.bit(i)}")
            else:
                words[i // gate.WORD] = words.get(i // gate.WORD, 0) | 1 << i % gate.WORD
        tests += [f"scanned AND (get(may_fire, {w}) & {bits}L) <> 0" for w, bits in words.items()]
        return " OR ".join(f"({t})" for t in tests) or "false"

    def _may_fire(self, index: int, rule: Rule) -> str:
        tests = [self._applies(rule), gate.bit(index)]
        return " AND ".join(tests + ([rule.when] if rule.when else []))

    def _hits(self, index: int, rule: Rule, wanted: Sequence[str]) -> str:
        """SQL array of what one rule finds in ``content`` or ``lines``."""
        match = rule.match_text if "match" in wanted else "''"
        every = rule.every_match if "metadata" in wanted else NO_TEXTS

        def hit(number: str) -> str:
            return f"named_struct('rule', {index}, 'line_no', {number}, 'match', {match}, 'every', {every})"

        if rule.every is not None:
            at_line = "transform(slice(lines, n, 1), line -> " + hit("n") + ")"
            found = f"flatten(transform({rule.every}, n -> {at_line}))"
        elif rule.at is not None:
            at_line = "transform(slice(lines, n, 1), line -> " + hit("n") + ")"
            found = f"flatten(transform(array_compact(array({rule.at})), n -> {at_line}))"
        else:
            tried = f"CASE WHEN {rule.line_condition} THEN {hit('pos + 1')} END"
            found = f"array_compact(transform(lines, (line, pos) -> {tried}))"
        return f"CASE WHEN {self._may_fire(index, rule)} THEN {found} ELSE {_NO_HITS} END"

    def _check_patterns(self, targets: DataFrame) -> None:
        """Compile the patterns of custom rules on the driver, so that no bad one reaches a task."""
        jvm = targets.sparkSession._jvm
        for rule in self.rules:
            if rule.pattern is not None and rule not in BUILTIN:
                try:
                    regex.compile_in_java(jvm, rule.pattern)
                except ValueError as error:
                    raise ValueError(f"rule {rule.id}: {error}") from None

    def _with_hits(
        self, targets: DataFrame, keep: Sequence[str], drop_clean: bool, wanted: Sequence[str] = FINDING_COLUMNS
    ) -> DataFrame:
        """Targets with ``hits``, which hold what the wanted fields of a finding are made of."""
        self._check_patterns(targets)
        kinds = self._classified(targets, keep)
        if drop_clean and self._only_kinds:
            kinds = kinds.filter("docker OR k8s")
        gated = self._gated(kinds)
        if not self.rules:
            return gated.withColumn("hits", F.expr(_NO_HITS))
        located = set(self._located)
        tried = gated.withColumn("tried", F.expr(self._tried()))
        if drop_clean:
            tried = tried.filter("tried OR size(found) > 0" if located else "tried")
        lines = F.when(F.col("tried"), text.split_lines(F.col("content")))
        others = ", ".join(self._hits(i, r, wanted) for i, r in enumerate(self.rules) if i not in located)
        hits = f"CASE WHEN tried THEN flatten(array({others})) ELSE {_NO_HITS} END" if others else _NO_HITS
        if located:
            # By rule and line, as without the gate's own hits.
            found = self._found_hits(wanted)
            hits = f"CASE WHEN tried THEN sort_array(concat({found}, {hits})) ELSE {found} END" if others else found
        return tried.withColumn("lines", lines).withColumn("hits", F.expr(hits))

    # --- findings ------------------------------------------------------------

    def _own_findings(self, wanted: Sequence[str]) -> list[Column]:
        """Arrays of findings of the own scanners, in the shape of the built-in ones."""
        arrays = []
        for scanner in self.options.own_scanners:
            lists = self.options.enabled_rules, self.options.disabled_rules
            if self.options.mode == REFERENCE and (
                (lists[0] and scanner.name not in lists[0]) or scanner.name in lists[1]
            ):
                continue

            found = scanner.find(F.col("path"), F.col("content"))
            arrays.append(F.when(F.col("type").isin(*scanner.types), F.transform(found, self._own_finding(scanner, wanted))))
        return arrays

    def _own_finding(self, scanner, wanted: Sequence[str]):
        """A function from what an own scanner returns to a finding."""

        def finding(f: Column) -> Column:
            def text(name: str) -> Column:
                return (f[name] if name in scanner.fields else F.lit("")).cast("string")

            line = f["line_no"].cast("int")
            key = F.concat_ws(":", F.col("path"), line.cast("string"), text("rule_id"))
            kind = F.lit(scanner.kind.lower())
            values = {
                "id": F.substring(F.sha2(key, 256), 1, 16),
                "file_path": F.col("path"), "start_line": line, "end_line": line,
                "type": F.lit(scanner.kind),
                "timestamp": F.lit(self.options.scan_time).cast("timestamp"),
                _MADE: F.lit(True),
                "metadata": F.create_map(F.lit("rule_name"), text("title"), F.lit("category"), kind),
            }
            return F.struct(*((values[n] if n in values else text(n)).alias(n) for n in wanted))

        return finding

    def _findings(self, wanted: Sequence[str] = FINDING_COLUMNS) -> Column:
        """SQL array of findings from ``hits``, with the wanted fields only."""
        constants = ", ".join(
            "named_struct("
            + ", ".join(
                f"'{name}', {quote(value)}"
                for name, value in (
                    ("rule_id", r.id), ("title", r.name), ("description", r.description),
                    ("severity", r.severity), ("type", r.type),
                    ("remediation", r.remediation), ("category", r.category),
                )
            )
            + ")"
            for r in self.rules or select_rules(ScanOptions())
        )
        rule = f"get(array({constants}), h.rule)"
        stamp = "CAST(NULL AS TIMESTAMP)"
        if self.options.scan_time:
            stamp = f"CAST({quote(self.options.scan_time.isoformat())} AS TIMESTAMP)"
        fields = {
            "id": finding_id("path", "h.line_no", "r.rule_id"),
            "rule_id": "r.rule_id",
            "title": "r.title",
            "description": "r.description",
            "severity": "r.severity",
            "type": "r.type",
            "file_path": "path",
            "start_line": "h.line_no",
            "end_line": "h.line_no",
            "match": "h.match",
            "remediation": "r.remediation",
            "metadata": "map_concat(map('rule_name', r.title, 'category', r.category),"
            " CASE WHEN size(h.every) > 1 THEN map('count', CAST(size(h.every) AS STRING),"
            " 'matches', array_join(h.every, ' ')) ELSE map() END)",
            "timestamp": stamp,
            _MADE: "true",
        }
        body = ", ".join(f"'{name}', {fields[name]}" for name in wanted)
        finding = secrets.bind(rule, "r", f"named_struct({body})")
        built = F.expr(f"transform(hits, h -> {finding})")
        own = self._own_findings(wanted)
        return F.flatten(F.array_compact(F.array(built, *own))) if own else built

    def results(
        self, targets: DataFrame, fields: Sequence[str] = FINDING_COLUMNS
    ) -> DataFrame:
        """One row per target: ``path type metadata error findings``.

        Totals need no more of a finding than ``fields=("severity",)``.
        """
        keep = ("type", "metadata")
        hits = self._with_hits(targets, keep, False, fields)
        return hits.select("path", *keep, "error", self._findings(fields).alias("findings"))

    def findings(
        self, targets: DataFrame, carry: Sequence[str] = (), fields: Sequence[str] = FINDING_COLUMNS
    ) -> DataFrame:
        """One row per rule and line it fires on, with the named fields only.

        ``carry`` names columns of the target to keep.
        """
        drop_clean = not self.options.own_scanners
        hits = self._with_hits(targets, ("type", *carry), drop_clean, fields)
        # An outer generator keeps the optimizer from working the findings out
        # a second time to tell whether there are any.
        rows = hits.select(*carry, self._findings((*fields, _MADE)).alias("_findings"))
        rows = rows.select(*carry, F.inline_outer("_findings"))
        return rows.filter(F.col(_MADE).isNotNull()).select(*fields, *carry)


def find(
    targets: DataFrame,
    options: ScanOptions | None = None,
    carry: Sequence[str] = (),
    fields: Sequence[str] = FINDING_COLUMNS,
) -> DataFrame:
    """Findings of a scan, one row each, with the columns of their target that ``carry`` names.

    Counts need no more of a finding than ``fields=("rule_id",)``.
    """
    return Matcher(options).findings(targets, carry, fields)


def scan(
    targets: DataFrame,
    options: ScanOptions | None = None,
    fields: Sequence[str] = FINDING_COLUMNS,
) -> DataFrame:
    """Results of a scan, one row per target."""
    return Matcher(options).results(targets, fields)


def number_lines(targets: DataFrame) -> DataFrame:
    """The lines of each target, numbered from one: ``path line_no line``."""
    filled = targets.filter(F.octet_length("content") > 0)
    lines = filled.select(
        "path", F.posexplode(text.split_lines(F.col("content"))).alias("pos", "line")
    )
    return lines.select("path", (F.col("pos") + 1).alias("line_no"), "line")
