"""The rule catalog: 20 secret, 12 Dockerfile and 17 Kubernetes rules.

A rule is a driver-side value that yields one boolean column over a line and
the facts of its file. Identifiers, names, severities, fixed match texts and
the Dockerfile and Kubernetes patterns are fixed values that results depend on;
the secret patterns are ours, written from public token formats. All patterns
are RE2 text (see ``functions.regex``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from auditlake.functions import regex, secrets, text
from auditlake.functions.sql import quote, rlike
from auditlake.model import (
    INTENT,
    MISCONFIG_SCANNER,
    MISCONFIGURATION,
    REFERENCE,
    SECRET,
    SECRET_SCANNER,
    SEVERITIES,
    ScanOptions,
)


@dataclass(frozen=True)
class Rule:
    """One rule; all conditions are Spark SQL text.

    Exactly one of these decides where it fires:

    - ``pattern``: RE2 text tried on each line;
    - ``line``: a condition on each ``line`` and its zero-based ``pos``;
    - ``at``: a line number worked out once from ``content``, null for none;
    - ``every``: an array of line numbers worked out once from ``lines``.

    ``when`` is a further condition on ``path`` and ``content``, tested once
    per file before its lines. ``gate`` is a pattern that matches in any text
    with a line that satisfies ``line``. ``guards`` are literals the pattern
    cannot match without (all groups, any literal of each); ``unless`` is a
    pattern that clears a line. ``match`` says what a finding reports: the ``"trimmed"`` or
    ``"raw"`` line, the ``"masked"`` secret (the first of ``tokens``, or what the
    pattern matches), or else a fixed text.
    """

    id: str
    name: str
    severity: str
    family: str
    description: str = ""
    remediation: str = ""
    pattern: str | None = None
    line: str | None = None
    at: str | None = None
    every: str | None = None
    when: str | None = None
    gate: str | None = None
    guards: tuple[tuple[str, ...], ...] = ()
    unless: str | None = None
    match: str = "trimmed"
    tokens: str | None = None
    file_types: tuple[str, ...] = ()

    @property
    def type(self) -> str:
        return SECRET if self.family == "secret" else MISCONFIGURATION

    @property
    def category(self) -> str:
        return self.type.lower()

    @property
    def line_condition(self) -> str:
        """Whether the rule fires on ``line``, whatever kind of file it is in."""
        if self.pattern is None:
            return self.line
        tests = [*contains_guards("line", self.guards), rlike("line", self.pattern)]
        if self.unless:
            tests.append(f"NOT {rlike('line', self.unless)}")
        return " AND ".join(tests)

    @property
    def match_text(self) -> str:
        """What a finding reports about ``line``."""
        if self.match == "masked":
            if self.pattern is None:
                found = f"get({self.tokens}, 0)"
            else:
                java = quote(regex.to_java(self.pattern))
                found = f"regexp_extract(line, {java}, 0)"
            return secrets.mask(found)
        if self.match == "trimmed":
            return text.trim_space_sql("line")
        return "line" if self.match == "raw" else quote(self.match)

    @property
    def every_match(self) -> str:
        """All that a secret rule masks on ``line``; a finding names further ones in its metadata."""
        if self.match != "masked":
            return "CAST(array() AS ARRAY<STRING>)"
        found = self.tokens
        if self.pattern is not None:
            found = f"regexp_extract_all(line, {quote(regex.to_java(self.pattern))}, 0)"
        return f"transform({found}, m -> {secrets.mask('m')})"


def contains_guards(value: str, guards: Sequence[Sequence[str]]) -> list[str]:
    """One condition per group of literals."""
    return [
        "(" + " OR ".join(f"contains({value}, {quote(x)})" for x in group) + ")"
        for group in guards
    ]


def _secret(id, severity, name, pattern, *guards, unless=None):
    return Rule(
        id, name, severity, "secret", f"Possible {name} in text",
        "Revoke the credential and load it from a secret store at run time",
        pattern=pattern, guards=guards, match="masked", unless=unless,
    )


# Identifiers, severities and names. The patterns are ours.
SECRET_RULES = (
    _secret("SEC001", "CRITICAL", "AWS Access Key ID",
            r"A(3T[A-Z0-9]|KIA|SIA|GPA|IDA|ROA|IPA|NPA|NVA)[A-Z0-9]{16}"),
    _secret("SEC002", "CRITICAL", "AWS Secret Access Key",
            r"""(?i)aws.{0,20}(secret|private).{0,30}['"][0-9a-z/+=]{40}['"]""", ("'", '"')),
    _secret("SEC003", "HIGH", "GitHub Personal Access Token", r"ghp_[A-Za-z0-9]{36}", ("ghp_",)),
    _secret("SEC004", "HIGH", "GitHub OAuth Access Token", r"gho_[A-Za-z0-9]{36}", ("gho_",)),
    _secret("SEC005", "HIGH", "GitHub App Token", r"gh[us]_[A-Za-z0-9]{36}", ("ghu_", "ghs_")),
    _secret("SEC006", "CRITICAL", "Stripe API Key",
            r"(sk|rk)_(live|test)_[0-9A-Za-z]{24,}", ("_live_", "_test_")),
    _secret("SEC007", "HIGH", "Google API Key", r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    _secret("SEC008", "HIGH", "Google OAuth Client Secret",
            r"GOCSPX-[0-9A-Za-z_-]{28}", ("GOCSPX-",)),
    _secret("SEC009", "HIGH", "Slack Bot Token",
            r"xoxb-[0-9]{10,13}-[0-9]{10,13}-[0-9A-Za-z]{24}", ("xoxb-",)),
    _secret("SEC010", "MEDIUM", "Slack Webhook URL",
            r"https://hooks\.slack\.com/services/T[0-9A-Z]+/B[0-9A-Z]+/[0-9A-Za-z]{24}",
            ("https://hooks.slack.com/services/T",)),
    _secret("SEC011", "CRITICAL", "RSA Private Key",
            r"-{5}BEGIN RSA PRIVATE KEY-{5}", ("-----BEGIN RSA PRIVATE KEY-----",)),
    _secret("SEC012", "CRITICAL", "SSH Private Key",
            r"-{5}BEGIN OPENSSH PRIVATE KEY-{5}", ("-----BEGIN OPENSSH PRIVATE KEY-----",)),
    _secret("SEC013", "MEDIUM", "JSON Web Token",
            r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", (".eyJ",),
            unless=r"(?i)example"),
    _secret("SEC014", "MEDIUM", "Generic API Key",
            r"""(?i)api[_-]?key['"]?[ \t]*[:=][ \t]*['"][0-9a-z_-]{16,}['"]""",
            (":", "="), ("'", '"')),
    _secret("SEC015", "HIGH", "Password in Code",
            r"""(?i)p(assword|asswd|wd)['"]?[ \t]*[:=][ \t]*['"][^'" \t]{8,}['"]""",
            (":", "="), ("'", '"')),
    _secret("SEC016", "HIGH", "Database Connection String",
            r"(?i)(mongodb(\+srv)?|postgres(ql)?|mysql|redis|amqp)"
            r"""://[^: \t/@]+:[^@ \t/]+@[^ \t'"]+""", ("://",), ("@",)),
    _secret("SEC017", "HIGH", "Twilio API Key", r"SK[0-9a-f]{32}", ("SK",)),
    _secret("SEC018", "HIGH", "SendGrid API Key",
            r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}", ("SG.",)),
    _secret("SEC019", "HIGH", "npm Token", r"npm_[0-9A-Za-z]{36}", ("npm_",)),
    _secret("SEC020", "HIGH", "Discord Bot Token",
            r"[MN][0-9A-Za-z_-]{23}\.[0-9A-Za-z_-]{6}\.[0-9A-Za-z_-]{27}", (".",)),
)


ENTROPY_RULE = Rule(
    "SECENT", "High Entropy String", "MEDIUM", "secret",
    "Quoted text random enough to be a secret that no other rule knows",
    "Revoke the credential and load it from a secret store at run time",
    gate=secrets.CANDIDATE, match="masked",
)


def _entropy_rule(named: Sequence[Rule]) -> Rule:
    """The rule for random quoted tokens that none of the named rules has matched.

    What the named rules match on the line is blanked out first, so that a token
    yields only to a rule that runs, and only where they overlap.
    """
    rest = "line"
    for cleared in (False, True):
        rules = [r for r in named if r.pattern and bool(r.unless) == cleared]
        if not rules:
            continue
        union = "|".join(f"(?:{regex.to_java(r.pattern)})" for r in rules)
        blanked = f"regexp_replace({rest}, {quote(union)}, ' ')"
        if cleared:
            unless = " OR ".join(rlike("line", r.unless) for r in rules)
            blanked = f"CASE WHEN {unless} THEN {rest} ELSE {blanked} END"
        rest = blanked
    tokens = secrets.bind(rest, "rest", secrets.random_candidates("rest"))
    return replace(
        ENTROPY_RULE,
        line=f"{rlike('line', secrets.CANDIDATE)} AND size({tokens}) > 0",
        tokens=tokens,
    )


def _blocks(outer: str, inner: str, leaf: str, flow: str) -> str:
    """Lines where a block with the key ``outer`` begins that holds ``inner`` with a ``leaf`` in it.

    One pass over the lines with the columns of the keys that are open: a line
    belongs to a key while it is indented further. ``flow`` is a pattern for a
    block written on one line. A document of its own begins with dashes.
    """
    def key(name: str) -> str:
        return rlike("l", rf"(?i)^[\t ]*(-[\t ]+)*{name}:")

    def state(outer: str, at: str, inner: str, hits: str) -> str:
        return f"named_struct('no', s.no + 1, 'outer', {outer}, 'at', {at}, 'inner', {inner}, 'hits', {hits})"

    def hit(test: str, at: str) -> str:
        return f"CASE WHEN {test} AND coalesce(try_element_at(s.hits, -1) <> {at}, true) THEN array_append(s.hits, {at}) ELSE s.hits END"

    here = rlike("l", flow)
    whole = rlike("l", rf"(?i){inner}:.*{leaf}")
    step = f"""CASE
     WHEN l RLIKE '^---' THEN {state("-1", "0", "-1", "s.hits")}
     WHEN l RLIKE '^[\t ]*(#|$)' THEN {state("s.outer", "s.at", "s.inner", "s.hits")}
     WHEN {key(outer)} THEN {state("c", "s.no + 1", "-1", hit(here, "s.no + 1"))}
     WHEN s.outer < 0 OR c <= s.outer THEN {state("-1", "0", "-1", hit(here, "s.no + 1"))}
     WHEN {key(inner)} THEN {state("s.outer", "s.at", "c", hit(whole, "s.at"))}
     WHEN s.inner >= 0 AND c > s.inner THEN {state("s.outer", "s.at", "s.inner", hit(rlike("l", f"(?i){leaf}"), "s.at"))}
     ELSE {state("s.outer", "s.at", "-1", "s.hits")} END"""
    column = "length(regexp_extract(l, '^[\\t ]*(-[\\t ]+)*', 0))"
    start = "named_struct('no', 0, 'outer', -1, 'at', 0, 'inner', -1, 'hits', CAST(array() AS ARRAY<INT>))"
    return f"aggregate(lines, {start}, (s, l) -> {secrets.bind(column, 'c', step)}, s -> s.hits)"


# The capabilities that give control of a node.
_POWERS = r"\b(SYS_ADMIN|NET_ADMIN|ALL|SYS_PTRACE)\b"


# --- Dockerfile rules ---------------------------------------------------------


def _untagged_image() -> str:
    space = text.UNICODE_SPACE
    untagged = rf"(?i)^[{space}]*FROM [{space}]*[^{space}:$]+([{space}]|$)"
    scratch = rf"^[{space}]*(?i:FROM) [{space}]*[^{space}]*scratch"
    return f"{rlike('line', untagged)} AND NOT {rlike('line', scratch)}"


def _local_add() -> str:
    added, remote = r"(?i)^ADD\s+\S+", r"(?i)^ADD\s+https?://"
    return f"{rlike('line', added)} AND NOT {rlike('line', remote)}"


def _recommended_packages() -> str:
    last = f"regexp_extract(line, {quote(regex.to_java(r'.*(apt-get\s+install.*)'))}, 1)"
    return (
        f"contains(line, 'apt-get') AND {last} <> ''"
        f" AND NOT contains({last}, '--no-install-recommends')"
    )


def _first_line_if(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 END"


NEVER = "CAST(NULL AS INT)"


def _docker(id, severity, name, description, remediation, **decides):
    return Rule(id, name, severity, "docker", description, remediation, **decides)


# Identifiers, severities, names, patterns and match texts.
DOCKER_RULES = (
    _docker("DOCKER001", "HIGH", "Running as Root User",
            "The image switches to the root user",
            "Switch to an unprivileged account, for example USER app",
            pattern=r"(?i)^USER\s+root\s*$"),
    _docker("DOCKER002", "MEDIUM", "Using Latest Tag",
            "The base image follows a moving tag, so builds differ over time",
            "Name a version of the base image",
            pattern=r"(?i)^FROM\s+\S+:latest\s*$"),
    _docker("DOCKER003", "MEDIUM", "No Tag Specified",
            "The base image has no tag and so follows a moving one",
            "Name a version of the base image",
            line=_untagged_image(), gate=r"(?i)FROM ", match="raw"),
    _docker("DOCKER004", "LOW", "ADD Instead of COPY",
            "ADD unpacks archives and fetches addresses, which local files do not need",
            "Copy local files with COPY",
            line=_local_add(), gate=r"(?i)ADD\s"),
    _docker("DOCKER005", "HIGH", "Secrets in Environment Variables",
            "An ENV value stays readable in the history of the image",
            "Mount the value as a build secret or set it when the container starts",
            pattern=r"(?i)^ENV\s+.*(PASSWORD|SECRET|KEY|TOKEN|CREDENTIAL|API_KEY).*="),
    _docker("DOCKER006", "CRITICAL", "Curl/Wget Piped to Shell",
            "A downloaded script runs without being checked",
            "Save the script, check its digest, then run it",
            pattern=r"(?i)(curl|wget)\s+.*\|\s*(sh|bash|zsh)"),
    _docker("DOCKER007", "LOW", "apt-get without --no-install-recommends",
            "Recommended packages are installed without being asked for",
            "Pass --no-install-recommends to apt-get install",
            line=_recommended_packages(), gate=r"apt-get\s+install"),
    _docker("DOCKER008", "LOW", "Missing apt-get Clean",
            "The package lists stay in the image",
            "Remove /var/lib/apt/lists in the step that installs packages",
            when="NOT (contains(content, 'apt-get clean')"
            " OR contains(content, 'rm -rf /var/lib/apt/lists'))",
            line="contains(line, 'apt-get install')", gate="apt-get install", match="raw"),
    _docker("DOCKER009", "MEDIUM", "HEALTHCHECK Not Defined",
            "The container gives no sign of whether it works",
            "Add a HEALTHCHECK instruction",
            at=_first_line_if("NOT contains(upper(content), 'HEALTHCHECK')"),
            match="No HEALTHCHECK instruction found"),
    _docker("DOCKER010", "MEDIUM", "Privileged Port Exposed",
            "A port below 1024 often needs root to be opened",
            "Listen on a port from 1024 up",
            pattern=r"(?i)^EXPOSE\s+(2[0-3]|1?[0-9]{1,2}|[1-9][0-9]{2})\s*$"),
    _docker("DOCKER011", "MEDIUM", "sudo Usage Detected",
            "A build step raises its own rights with sudo",
            "Run the step as the user it needs",
            pattern=r"(?i)\bsudo\b"),
    _docker("DOCKER012", "HIGH", "Missing USER Instruction",
            "Without a USER instruction the container runs as root",
            "Add a USER instruction with an unprivileged account",
            at=_first_line_if(r"NOT contains(upper(content), '\nUSER ')"),
            match="No USER instruction found"),
)


# --- Kubernetes rules ---------------------------------------------------------


def _k8s(id, severity, name, description, remediation, **decides):
    return Rule(id, name, severity, "k8s", description, remediation, **decides)


# Identifiers, severities, names, patterns and match texts.
K8S_RULES = (
    _k8s("K8S001", "CRITICAL", "Privileged Container",
         "The container has all rights on its node", "Remove privileged: true",
         pattern=r"(?i)privileged:\s*true"),
    _k8s("K8S002", "HIGH", "Running as Root",
         "The container runs with user id 0", "Set runAsUser to a number above 0",
         pattern=r"(?i)runAsUser:\s*0\b"),
    _k8s("K8S003", "MEDIUM", "Root Filesystem Not Read-Only",
         "The container can change its own files", "Make the root filesystem read-only",
         pattern=r"(?i)readOnlyRootFilesystem:\s*false"),
    _k8s("K8S004", "HIGH", "Privilege Escalation Allowed",
         "A process can gain more rights than its parent",
         "Set allowPrivilegeEscalation to false",
         pattern=r"(?i)allowPrivilegeEscalation:\s*true"),
    _k8s("K8S005", "HIGH", "Host Network Access",
         "The pod shares the network of its node", "Remove hostNetwork: true",
         pattern=r"(?i)hostNetwork:\s*true"),
    _k8s("K8S006", "HIGH", "Host PID Namespace",
         "The pod sees all processes of its node", "Remove hostPID: true",
         pattern=r"(?i)hostPID:\s*true"),
    _k8s("K8S007", "MEDIUM", "Host IPC Namespace",
         "The pod shares memory segments with its node", "Remove hostIPC: true",
         pattern=r"(?i)hostIPC:\s*true"),
    _k8s("K8S008", "CRITICAL", "Dangerous Capabilities Added",
         "The container is given a capability that can control its node",
         "Add only the capabilities the program needs",
         gate=r"(?i)capabilities:",
         every=_blocks("capabilities", "add", _POWERS,
                       rf"(?i)capabilities:.*\badd:\s*\[?[^\]}}]*{_POWERS}")),
    _k8s("K8S009", "MEDIUM", "No Resource Limits",
         "The container can use up the resources of its node",
         "Set limits for processor and memory",
         when="NOT contains(content, 'limits:')", line="contains(line, 'containers:')",
         gate="containers:",
         match="No resource limits defined"),
    _k8s("K8S010", "MEDIUM", "Latest Image Tag",
         "The image follows a moving tag", "Name a version of the image",
         pattern=r"(?i)image:\s*\S+:latest"),
    _k8s("K8S011", "HIGH", "Host Path Volume Mount",
         "The pod mounts files of its node", "Use a persistent volume",
         pattern=r"(?i)hostPath:"),
    _k8s("K8S012", "LOW", "Default Service Account",
         "The pod runs with the default account of its namespace",
         "Make an account with only the rights the pod needs",
         pattern=r"(?i)serviceAccountName:\s*default"),
    _k8s("K8S013", "MEDIUM", "Secrets in Environment Variables",
         "A secret in the environment can end up in logs", "Mount the secret as a file",
         gate=r"(?i)secretKeyRef:",
         every=_blocks("env", "valueFrom", "secretKeyRef:",
                       r"(?i)\benv:.*valueFrom:.*secretKeyRef:")),
    _k8s("K8S014", "MEDIUM", "Missing Network Policy",
         "The deployment comes without a network policy",
         "Add a NetworkPolicy for the pods of the deployment",
         at=_first_line_if("contains(content, 'kind: Deployment')"
                           " AND NOT contains(content, 'kind: NetworkPolicy')"),
         match="No NetworkPolicy defined"),
    _k8s("K8S015", "CRITICAL", "Writable /proc Mount",
         "An unmasked /proc can be a way out of the container",
         "Leave procMount at its default",
         pattern=r"(?i)procMount:\s*Unmasked"),
    _k8s("K8S016", "MEDIUM", "Missing Security Context",
         "Neither the pod nor its containers have a security context",
         "Add a securityContext",
         at=_first_line_if("contains(content, 'containers:')"
                           " AND NOT contains(content, 'securityContext:')"),
         match="securityContext not found"),
    _k8s("K8S017", "MEDIUM", "RunAsNonRoot Not Set",
         "Nothing keeps the containers from running as root",
         "Set runAsNonRoot to true in the securityContext",
         at=_first_line_if("contains(content, 'containers:')"
                           " AND NOT contains(content, 'runAsNonRoot: true')"),
         match="runAsNonRoot: true not found"),
)

# Rules whose file-wide checks run for every manifest, also one named like a Dockerfile.
WHOLE_MANIFEST = ("K8S016", "K8S017")

# What four rules do in reference mode, where a rule without a
# working pattern never fires and a pattern sees one line at a time.
REFERENCE_RULES = {
    "DOCKER004": {"line": None, "gate": None, "at": NEVER},
    "DOCKER007": {"line": None, "gate": None, "at": NEVER},
    "K8S008": {
        "every": None,
        "gate": None,
        "pattern": r"(?i)capabilities:[\s\S]*?add:[\s\S]*?(SYS_ADMIN|NET_ADMIN|ALL|SYS_PTRACE)",
    },
    "K8S013": {"every": None, "gate": None, "pattern": r"(?i)env:[\s\S]*?valueFrom:[\s\S]*?secretKeyRef:"},
}


def builtin_rules(mode: str = INTENT, entropy: bool = False) -> tuple[Rule, ...]:
    rules = SECRET_RULES + DOCKER_RULES + K8S_RULES
    if mode == REFERENCE:
        rules = tuple(replace(r, **REFERENCE_RULES.get(r.id, {})) for r in rules)
    return rules + ((_entropy_rule(SECRET_RULES),) if entropy else ())


def custom_rule(
    id: str,
    name: str,
    severity: str,
    pattern: str | None = None,
    *,
    line: str | None = None,
    family: str = "custom",
    file_types: Iterable[str] = (),
    description: str = "",
    remediation: str = "",
) -> Rule:
    """A user rule from a pattern or a SQL condition on ``line``, checked on the driver.

    ``family`` ``"docker"`` or ``"k8s"`` limits it to those files; ``"custom"``
    tries it on every target whose base name fits one of the ``file_types``
    globs (all targets when there are none).
    """
    if (pattern is None) == (line is None):
        raise ValueError(f"rule {id} needs either a pattern or a condition")
    if family not in ("docker", "k8s", "custom"):
        raise ValueError(f"unknown family for rule {id}: {family}")
    if severity.upper() not in SEVERITIES:
        raise ValueError(f"unknown severity for rule {id}: {severity}")
    if pattern is not None:
        try:
            regex.to_java(pattern)
        except ValueError as error:
            raise ValueError(f"invalid pattern for rule {id}: {error}") from None
    return Rule(
        id, name, severity.upper(), family, description, remediation,
        pattern=pattern, line=line, file_types=tuple(file_types),
    )


def rules_from_config(entries: Iterable[dict]) -> tuple[Rule, ...]:
    """Custom rules from the mappings of a configuration file."""
    return tuple(
        custom_rule(
            e["id"], e.get("name", ""), e.get("severity", "MEDIUM"), e["pattern"],
            file_types=e.get("file_types") or (),
            description=e.get("description", ""), remediation=e.get("remediation", ""),
        )
        for e in entries
    )


def select_rules(options: ScanOptions) -> tuple[Rule, ...]:
    """The rules one scan runs, chosen before any plan is built."""
    families = options.scanner_families
    rules = builtin_rules(options.mode, options.entropy) + tuple(options.custom_rules)
    rules = tuple(r for r in rules if r.family in families)
    if options.mode == REFERENCE:
        return tuple(r for r in rules if _scanner_enabled(r, options))
    wanted = {s.upper() for s in options.severities}
    running = tuple(
        r
        for r in rules
        if (not options.enabled_rules or r.id in options.enabled_rules)
        and r.id not in options.disabled_rules
        and (not wanted or r.severity in wanted)
    )
    named = tuple(r for r in running if r.family == "secret" and r.id != ENTROPY_RULE.id)
    return tuple(_entropy_rule(named) if r.id == ENTROPY_RULE.id else r for r in running)


def _scanner_enabled(rule: Rule, options: ScanOptions) -> bool:
    scanner = SECRET_SCANNER if rule.family == "secret" else MISCONFIG_SCANNER
    enabled = not options.enabled_rules or scanner in options.enabled_rules
    return enabled and scanner not in options.disabled_rules


def catalog(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rules as rows."""
    rules = builtin_rules() if rules is None else rules
    rows = [
        (r.id, r.severity, r.name, r.description, r.type, r.family, r.remediation)
        for r in rules
    ]
    schema = (
        "rule_id string, severity string, name string, description string, "
        "type string, family string, remediation string"
    )
    return spark.createDataFrame(rows, schema)

