"""SQL that works the registered queries out another way, for checking them.

Only the derived targets (``fixtures``) are shared with the queries. Rules are
stated here on their own, as plain patterns over a table of lines, one
``SELECT`` per rule, and aggregated with joins and grouping.
"""

from __future__ import annotations

from auditlake.plans import fixtures as fx

# Identifier, severity, name, description-free pattern.
SECRETS = (
    ("SEC001", "CRITICAL", "AWS Access Key ID",
     "(A3T[A-Z0-9]|AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}"),
    ("SEC002", "CRITICAL", "AWS Secret Access Key",
     "(?i)aws.{0,20}(secret|private).{0,30}['\"][0-9a-z/+=]{40}['\"]"),
    ("SEC003", "HIGH", "GitHub Personal Access Token", "ghp_[A-Za-z0-9]{36}"),
    ("SEC004", "HIGH", "GitHub OAuth Access Token", "gho_[A-Za-z0-9]{36}"),
    ("SEC005", "HIGH", "GitHub App Token", "(ghu|ghs)_[A-Za-z0-9]{36}"),
    ("SEC006", "CRITICAL", "Stripe API Key", "(sk|rk)_(live|test)_[0-9A-Za-z]{24,}"),
    ("SEC007", "HIGH", "Google API Key", "AIza[0-9A-Za-z_-]{35}"),
    ("SEC008", "HIGH", "Google OAuth Client Secret", "GOCSPX-[0-9A-Za-z_-]{28}"),
    ("SEC009", "HIGH", "Slack Bot Token", "xoxb-[0-9]{10,13}-[0-9]{10,13}-[0-9A-Za-z]{24}"),
    ("SEC010", "MEDIUM", "Slack Webhook URL",
     r"https://hooks\.slack\.com/services/T[0-9A-Z]+/B[0-9A-Z]+/[0-9A-Za-z]{24}"),
    ("SEC011", "CRITICAL", "RSA Private Key", "-{5}BEGIN RSA PRIVATE KEY-{5}"),
    ("SEC012", "CRITICAL", "SSH Private Key", "-{5}BEGIN OPENSSH PRIVATE KEY-{5}"),
    ("SEC013", "MEDIUM", "JSON Web Token",
     r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}"),
    ("SEC014", "MEDIUM", "Generic API Key",
     "(?i)(api[_-]?key|apikey)['\"]?[ \\t]*[:=][ \\t]*['\"][0-9a-z_-]{16,}['\"]"),
    ("SEC015", "HIGH", "Password in Code",
     "(?i)(password|passwd|pwd)['\"]?[ \\t]*[:=][ \\t]*['\"][^'\" \\t]{8,}['\"]"),
    ("SEC016", "HIGH", "Database Connection String",
     r"(?i)(mongodb(\+srv)?|postgres(ql)?|mysql|redis|amqp)"
     "://[^: \\t/@]+:[^@ \\t/]+@[^ \\t'\"]+"),
    ("SEC017", "HIGH", "Twilio API Key", "SK[0-9a-f]{32}"),
    ("SEC018", "HIGH", "SendGrid API Key", r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}"),
    ("SEC019", "HIGH", "npm Token", "npm_[0-9A-Za-z]{36}"),
    ("SEC020", "HIGH", "Discord Bot Token",
     r"[MN][0-9A-Za-z_-]{23}\.[0-9A-Za-z_-]{6}\.[0-9A-Za-z_-]{27}"),
)
CANDIDATE = "['\"]([0-9a-f]{32,}|[0-9A-Za-z+/_-]{32,}={0,2})['\"]"

# Identifier, severity, name, then a condition on one line.
DOCKER = (
    ("DOCKER001", "HIGH", "Running as Root User",
     r"regexp_matches(line, '(?i)^USER\s+root\s*$')", "trimmed"),
    ("DOCKER002", "MEDIUM", "Using Latest Tag",
     r"regexp_matches(line, '(?i)^FROM\s+\S+:latest\s*$')", "trimmed"),
    ("DOCKER003", "MEDIUM", "No Tag Specified",
     r"""starts_with(upper(trim(line)), 'FROM ')
      AND NOT regexp_matches(string_split_regex(trim(line), '\s+')[2], '[:$]|scratch')""", "line"),
    ("DOCKER005", "HIGH", "Secrets in Environment Variables",
     r"regexp_matches(line, '(?i)^ENV\s+.*(PASSWORD|SECRET|KEY|TOKEN|CREDENTIAL|API_KEY).*=')",
     "trimmed"),
    ("DOCKER006", "CRITICAL", "Curl/Wget Piped to Shell",
     r"regexp_matches(line, '(?i)(curl|wget)\s+.*\|\s*(sh|bash|zsh)')", "trimmed"),
    ("DOCKER008", "LOW", "Missing apt-get Clean",
     """contains(line, 'apt-get install') AND NOT contains(content, 'apt-get clean')
      AND NOT contains(content, 'rm -rf /var/lib/apt/lists')""", "line"),
    ("DOCKER009", "MEDIUM", "HEALTHCHECK Not Defined",
     "line_no = 1 AND NOT contains(upper(content), 'HEALTHCHECK')",
     "'No HEALTHCHECK instruction found'"),
    ("DOCKER010", "MEDIUM", "Privileged Port Exposed",
     r"regexp_matches(line, '(?i)^EXPOSE\s+(2[0-3]|1?[0-9]{1,2}|[1-9][0-9]{2})\s*$')", "trimmed"),
    ("DOCKER011", "MEDIUM", "sudo Usage Detected",
     r"regexp_matches(line, '(?i)\bsudo\b')", "trimmed"),
    ("DOCKER012", "HIGH", "Missing USER Instruction",
     "line_no = 1 AND NOT contains(upper(content), chr(10) || 'USER ')",
     "'No USER instruction found'"),
)
DOCKER_INTENT = (
    ("DOCKER004", "LOW", "ADD Instead of COPY",
     r"""regexp_matches(line, '(?i)^ADD\s+\S+')
      AND NOT regexp_matches(line, '(?i)^ADD\s+https?://')""", "trimmed"),
    ("DOCKER007", "LOW", "apt-get without --no-install-recommends",
     r"""regexp_matches(line, 'apt-get\s+install')
      AND NOT regexp_matches(line, 'apt-get\s+install.*--no-install-recommends')""", "trimmed"),
)
K8S = tuple(
    (rule, severity, name, rf"regexp_matches(line, '{pattern}')", "trimmed")
    for rule, severity, name, pattern in (
        ("K8S001", "CRITICAL", "Privileged Container", r"(?i)privileged:\s*true"),
        ("K8S002", "HIGH", "Running as Root", r"(?i)runAsUser:\s*0\b"),
        ("K8S003", "MEDIUM", "Root Filesystem Not Read-Only",
         r"(?i)readOnlyRootFilesystem:\s*false"),
        ("K8S004", "HIGH", "Privilege Escalation Allowed",
         r"(?i)allowPrivilegeEscalation:\s*true"),
        ("K8S005", "HIGH", "Host Network Access", r"(?i)hostNetwork:\s*true"),
        ("K8S006", "HIGH", "Host PID Namespace", r"(?i)hostPID:\s*true"),
        ("K8S007", "MEDIUM", "Host IPC Namespace", r"(?i)hostIPC:\s*true"),
        ("K8S010", "MEDIUM", "Latest Image Tag", r"(?i)image:\s*\S+:latest"),
        ("K8S011", "HIGH", "Host Path Volume Mount", r"(?i)hostPath:"),
        ("K8S012", "LOW", "Default Service Account", r"(?i)serviceAccountName:\s*default"),
        ("K8S015", "CRITICAL", "Writable /proc Mount", r"(?i)procMount:\s*Unmasked"),
    )
) + (
    ("K8S009", "MEDIUM", "No Resource Limits",
     "contains(line, 'containers:') AND NOT contains(content, 'limits:')",
     "'No resource limits defined'"),
    ("K8S014", "MEDIUM", "Missing Network Policy",
     """line_no = 1 AND contains(content, 'kind: Deployment')
      AND NOT contains(content, 'kind: NetworkPolicy')""", "'No NetworkPolicy defined'"),
    ("K8S016", "MEDIUM", "Missing Security Context",
     """line_no = 1 AND contains(content, 'containers:')
      AND NOT contains(content, 'securityContext:')""", "'securityContext not found'"),
    ("K8S017", "MEDIUM", "RunAsNonRoot Not Set",
     """line_no = 1 AND contains(content, 'containers:')
      AND NOT contains(content, 'runAsNonRoot: true')""", "'runAsNonRoot: true not found'"),
)


def _blockwise(rule, severity, name, key, rest):
    """True on lines with a ``key`` whose own block, up to the next key, goes on as ``rest`` says."""
    parts = f"string_split_regex(content, '(?i)\\b{key}:')"
    before = f"array_to_string({parts}[:k], 'x')"
    lines = f"""list_transform(list_filter(generate_series(1, len({parts}) - 1),
      lambda k: regexp_matches({parts}[k + 1], '{rest}')),
      lambda k: 1 + length({before}) - length(replace({before}, chr(10), '')))"""
    return (rule, severity, name, f"list_contains({lines}, line_no)", "trimmed")


POWERS = "(SYS_ADMIN|NET_ADMIN|ALL|SYS_PTRACE)"
K8S_INTENT = (
    _blockwise("K8S008", "CRITICAL", "Dangerous Capabilities Added", "capabilities",
               rf"^\s*\{{?\s*add:\s*(\[[^\]]*\b{POWERS}\b|(- \w+\s+)*- {POWERS}\b)"),
    _blockwise("K8S013", "MEDIUM", "Secrets in Environment Variables", "env",
               r"(?s)^[^:]*(name: \w+\s+)?([a-z]+: [a-z]\s+- name: \w+\s+)*[\s{\[]*valueFrom:[\s{]*secretKeyRef:"),
)
K8S_REFERENCE = (
    ("K8S008", "CRITICAL", "Dangerous Capabilities Added",
     r"""regexp_matches(line,
      '(?i)capabilities:[\s\S]*?add:[\s\S]*?(SYS_ADMIN|NET_ADMIN|ALL|SYS_PTRACE)')""", "trimmed"),
    ("K8S013", "MEDIUM", "Secrets in Environment Variables",
     r"regexp_matches(line, '(?i)env:[\s\S]*?valueFrom:[\s\S]*?secretKeyRef:')", "trimmed"),
)

DOCKERFILES = f"SELECT {fx.DOCKER_PATH} AS path, {fx.DOCKER_CONTENT} AS content FROM part"
MANIFESTS = f"SELECT {fx.K8S_PATH} AS path, {fx.K8S_CONTENT} AS content FROM part"
CONFIGS = f"SELECT {fx.SECRET_PATH} AS path, {fx.SECRET_CONTENT} AS content FROM customer"
LONG = f"SELECT {fx.LONG_PATH} AS path, {fx.LONG_CONTENT} AS content FROM supplier"
DOCUMENTS = f"SELECT {fx.DOCUMENT_PATH} AS path, text AS content FROM documents"
REPOSITORY = f"SELECT {fx.REPO_PATH} AS path, text AS content FROM documents"
CONVERSATIONS = f"SELECT {fx.CONVERSATION_PATH} AS path, {fx.CONVERSATION_CONTENT} AS content FROM conversations"
PAGES = f"""SELECT {fx.PAGE_PATH} AS path, replace(replace(replace(replace(replace(replace({fx.PAGE_CONTENT},
 '&quot;', '"'), '&#34;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')
 AS content FROM pages"""
EVERYTHING = " UNION ALL ".join((DOCKERFILES, MANIFESTS, CONFIGS, LONG, DOCUMENTS, PAGES, CONVERSATIONS))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lines(targets: str) -> str:
    """``WITH`` tables ``t`` (targets with kinds) and ``l`` (numbered lines)."""
    return f"""WITH t0 AS ({targets}),
 t AS (SELECT path, content,
  ends_with(lower(path), 'dockerfile') OR contains(lower(path), 'dockerfile.') AS docker,
  regexp_matches(lower(path), '[.]ya?ml$') AND contains(content, 'apiVersion:')
   AND (contains(content, 'kind:') OR contains(content, 'metadata:')) AS k8s FROM t0),
 e AS (SELECT *, CASE WHEN (docker OR k8s) AND len(list_filter(string_split(content, chr(10)),
   lambda x: strlen(x) >= 65536)) > 0 THEN 'line too long' END AS error FROM t),
 s AS (SELECT *, string_split(regexp_replace(content, '\\n\\z', ''), chr(10)) AS ls
  FROM e WHERE content <> ''),
 n AS (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM s),
 l AS (SELECT path, content, docker, k8s, error, CAST(i AS INTEGER) AS line_no,
  regexp_replace(ls[i], '\\r\\z', '') AS line FROM n)"""


def _row(rule, severity, kind, match, where):
    return (
        f"SELECT {_text(rule)} AS rule_id, {_text(severity)} AS severity, {_text(kind)} AS type,"
        f" path AS file_path, line_no AS start_line, {match} AS match FROM l WHERE {where}"
    )


def _masked(found: str) -> str:
    return (
        f"CASE WHEN length({found}) <= 8 THEN repeat('*', length({found})) ELSE left({found}, 4)"
        f" || repeat('*', length({found}) - 8)"
        f" || right({found}, least(4, length({found}) - 8)) END"
    )


def _entropy_row(named) -> str:
    """Random quoted tokens of what the named patterns leave of a line."""
    union = "|".join(f"(?:{p[3]})" for p in named if p[0] != "SEC013")
    jwt = [p[3] for p in named if p[0] == "SEC013"]
    rest = f"regexp_replace(line, {_text(union)}, ' ', 'g')" if union else "line"
    if jwt:
        rest = f"""CASE WHEN regexp_matches(line, '(?i)example') THEN {rest}
         ELSE regexp_replace({rest}, {_text(jwt[0])}, ' ', 'g') END"""
    tokens = f"""list_filter(regexp_extract_all({rest}, {_text(CANDIDATE)}, 1),
         lambda x: list_entropy(string_split(x, '')) >
          CASE WHEN regexp_matches(x, '^[0-9a-f]+$') THEN 3.0 ELSE 4.5 END)"""
    where = f"""regexp_matches(line, '["''][0-9A-Za-z+/_-]{{32}}') AND len({tokens}) > 0"""
    return _row("SECENT", "MEDIUM", "SECRET", _masked(f"({tokens})[1]"), where)


def _secret_rows(entropy: bool = False) -> list[str]:
    rows = []
    for rule, severity, _, pattern in SECRETS:
        where = f"regexp_matches(line, {_text(pattern)})"
        if rule == "SEC013":
            where += " AND NOT regexp_matches(line, '(?i)example')"
        found = _masked(f"regexp_extract(line, {_text(pattern)})")
        rows.append(_row(rule, severity, "SECRET", found, where))
    if entropy:
        rows.append(_entropy_row(SECRETS))
    return rows


def _misconfig_rows(rules, kind: str, reference: bool) -> list[str]:
    rows = []
    for rule, severity, _, test, match in rules:
        match = r"regexp_replace(line, '^\s+|\s+$', '', 'g')" if match == "trimmed" else match
        gate = "docker" if kind == "docker" else "k8s AND NOT docker"
        gate = "k8s" if rule in ("K8S016", "K8S017") else gate
        where = f"{gate} AND {test}" + (" AND error IS NULL" if reference else "")
        rows.append(_row(rule, severity, "MISCONFIGURATION", match, where))
    return rows


def _docker_rows(reference: bool = False) -> list[str]:
    return _misconfig_rows(DOCKER if reference else DOCKER + DOCKER_INTENT, "docker", reference)


def _k8s_rows(reference: bool = False) -> list[str]:
    return _misconfig_rows(K8S + (K8S_REFERENCE if reference else K8S_INTENT), "k8s", reference)


def _found(targets: str, rows: list[str]) -> str:
    """``WITH`` tables down to ``f``, the findings with their identifiers."""
    union = " UNION ALL ".join(rows)
    return f"""{_lines(targets)}, f0 AS ({union}),
 f AS (SELECT substring(sha256(concat(file_path, ':', start_line, ':', rule_id)), 1, 16) AS id,
  * FROM f0)"""


ALL_ROWS = _secret_rows() + _docker_rows() + _k8s_rows()
ALL_REFERENCE = _secret_rows() + _docker_rows(True) + _k8s_rows(True)
ALL = _found(EVERYTHING, ALL_ROWS)
SHOW = "SELECT id, rule_id, severity, type, file_path, start_line, match FROM f"
RANK = """CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2
 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END"""
LEVEL = """CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM'
 THEN 'warning' WHEN severity = 'LOW' THEN 'note' ELSE 'none' END"""
NAMES = {r[0]: (r[1], r[2]) for r in SECRETS + DOCKER + DOCKER_INTENT + K8S + K8S_INTENT}
RULES = "(VALUES " + ", ".join(
    f"({_text(i)}, {_text(s)}, {_text(n)})" for i, (s, n) in sorted(NAMES.items())
) + ") AS c(rule_id, severity, name)"
EXCLUDED = """'.git', '.svn', '.hg', 'node_modules', 'vendor', '__pycache__', '.venv', 'venv',
 '.idea', '.vscode', 'dist', 'build', 'target', '.terraform'"""
BINARY = """'exe', 'dll', 'so', 'dylib', 'bin', 'dat', 'db', 'sqlite', 'png', 'jpg', 'jpeg', 'gif',
 'bmp', 'ico', 'webp', 'svg', 'mp3', 'mp4', 'avi', 'mov', 'pdf', 'doc', 'docx', 'xls', 'xlsx',
 'ppt', 'pptx', 'zip', 'tar', 'gz', 'rar', '7z', 'bz2', 'xz', 'woff', 'woff2', 'ttf', 'eot',
 'lock', 'sum'"""
BASE = "string_split(path, '/')[-1]"
EXTENSION = rf"lower(regexp_extract({BASE}, '[.]([^.]*)$', 1))"
WANTED = f"""NOT list_has_any(string_split(path, '/'), [{EXCLUDED}])
 AND NOT (contains({BASE}, '.') AND {EXTENSION} IN ({BINARY}))"""
N_BYTES = "strlen(content)"
SIZE = f"""CASE WHEN {N_BYTES} < 1024 THEN printf('%d B', {N_BYTES})
 WHEN {N_BYTES} < 1048576 THEN printf('%.1f KB', {N_BYTES} / 1024.0)
 ELSE printf('%.1f MB', {N_BYTES} / 1048576.0) END"""


def _summary(found: str, reference: bool = False) -> str:
    """``WITH`` tables down to ``m``, the one row of totals."""
    kept = "e.error IS NULL" if reference else "true"
    counts = ", ".join(
        f"CAST(count(*) FILTER (WHERE severity = '{s.upper()}') AS BIGINT) AS {s}_count"
        for s in ("critical", "high", "medium", "low", "info")
    )
    return f"""{found}, m AS (SELECT * FROM
 (SELECT count(*) AS total_targets, count(*) FILTER (WHERE error IS NULL) AS scanned_targets,
   count(error) AS errors FROM e),
 (SELECT count(*) AS total_findings, {counts} FROM f JOIN e ON e.path = f.file_path
   WHERE {kept}))"""


SUMMARY = _summary(ALL)
DOCKER_FOUND = _found(DOCKERFILES, _docker_rows())
K8S_FOUND = _found(MANIFESTS, _k8s_rows())
PLANTED = _found(CONFIGS, _secret_rows())
NUMBERED = f"""{DOCKER_FOUND}, o AS (SELECT row_number() OVER (ORDER BY rank, file_path, start_line,
 rule_id) AS ordinal, * FROM (SELECT *, {RANK} AS rank FROM f) x JOIN
 (SELECT rule_id, name FROM {RULES}) USING (rule_id))"""

ORACLE: dict[str, str] = {
    "secret_findings_documents": f"{_found(DOCUMENTS, _secret_rows(True))} {SHOW}",
    "secret_findings_conversations": f"{_found(CONVERSATIONS, _secret_rows(True))} {SHOW}",
    "secret_findings_pages": f"{_found(PAGES, _secret_rows(True))} {SHOW}",
    "secret_planted": f"{PLANTED} {SHOW}",
    "secret_masked": f"""{PLANTED} SELECT rule_id, match, length(match) AS n_chars,
 length(match) - length(replace(match, '*', '')) AS n_hidden FROM f""",
    "secret_allowlist": f"""SELECT {fx.SECRET_PATH} AS file_path, CAST(2 AS INTEGER) AS start_line
 FROM customer WHERE c_custkey % 20 = 12 AND c_custkey % 40 <> 12""",
    "entropy_candidates": f"""{_lines(DOCUMENTS)}, c AS (SELECT path, line_no,
 unnest(regexp_extract_all(line, {_text(CANDIDATE)}, 1)) AS token FROM l)
 SELECT path, line_no, token, round(list_entropy(string_split(token, '')), 6) AS entropy FROM c""",
    "docker_findings": f"{DOCKER_FOUND} {SHOW}",
    "docker_findings_reference": f"{_found(DOCKERFILES, _docker_rows(True))} {SHOW}",
    "docker_rule_counts": f"{DOCKER_FOUND} SELECT rule_id, count(*) AS findings FROM f GROUP BY ALL",
    "k8s_findings": f"{K8S_FOUND} {SHOW}",
    "k8s_findings_reference": f"{_found(MANIFESTS, _k8s_rows(True))} {SHOW}",
    "k8s_rule_counts": f"""{K8S_FOUND} SELECT rule_id, severity, count(*) AS findings FROM f
 GROUP BY ALL""",
    "k8s_file_checks": f"""{K8S_FOUND} SELECT rule_id, file_path, start_line, match FROM f
 WHERE rule_id IN ('K8S014', 'K8S016', 'K8S017')""",
    "custom_rules": rf"""{_lines(REPOSITORY)}, f AS (
 SELECT 'CUSTOM001' AS rule_id, 'LOW' AS severity, path, line_no FROM l
  WHERE regexp_matches(line, '(?i)\b[a-z0-9._-]+@[a-z0-9-]+\.(com|org|net)\b')
 UNION ALL SELECT 'CUSTOM002', 'MEDIUM', path, line_no FROM l
  WHERE (ends_with(path, '.py') OR ends_with(path, '.go'))
   AND regexp_matches(line, '^(The|Die|Le|La|El)\s')
 UNION ALL SELECT 'CUSTOM003', 'INFO', path, line_no FROM l WHERE length(line) > 2000)
 SELECT substring(sha256(concat(path, ':', line_no, ':', rule_id)), 1, 16) AS id, rule_id, severity,
  path AS file_path, line_no AS start_line FROM f""",
    "custom_k8s_rule": f"""{_lines(MANIFESTS)} SELECT
 substring(sha256(concat(path, ':', line_no, ':CUSTOM010')), 1, 16) AS id, 'CUSTOM010' AS rule_id,
 'MEDIUM' AS severity, 'MISCONFIGURATION' AS type, path AS file_path, line_no AS start_line,
 line AS match FROM l WHERE line = 'kind: Pod'""",
    "extra_scanner": f"""{_found(DOCUMENTS, _secret_rows(True))} {SHOW} UNION ALL
 SELECT substring(sha256(concat(path, ':1:SHORT')), 1, 16), 'SHORT', 'INFO', 'MISCONFIGURATION',
  path, CAST(1 AS INTEGER), length(content) || ' characters' FROM t WHERE length(content) < 200""",
    **{name: f"""{_found(DOCUMENTS, _secret_rows(True))} {SHOW} UNION ALL
 SELECT substring(sha256(concat(path, ':1:SHORT')), 1, 16), 'SHORT', 'INFO', 'MISCONFIGURATION',
  path, CAST(1 AS INTEGER), length(content) || ' characters' FROM t WHERE length(content) < 200"""
       for name in ("own_scanner", "own_scanner_stream")},
    "python_scanner": f"""{_found(DOCUMENTS, _secret_rows())}, w AS (SELECT file_path, rule_id, severity, start_line, match FROM f
 UNION ALL SELECT path, 'WIDE', 'LOW', line_no, length(line) || ' characters' FROM l WHERE length(line) > 400)
 SELECT * FROM w UNION ALL SELECT 'all', 'TOTAL', 'INFO', CAST(count(*) FILTER (severity = 'LOW') AS INTEGER),
  CAST(count(*) AS VARCHAR) FROM w""",
    "own_scanner_summary": f"""{_found(DOCUMENTS, _secret_rows(True))}, short AS (SELECT count(*) AS n
 FROM t WHERE length(content) < 200) SELECT (SELECT count(*) FROM t) AS total_targets,
 (SELECT count(*) FROM f) + n AS total_findings,
 (SELECT count(*) FROM f WHERE severity = 'INFO') + n AS info_count FROM short""",
    "rule_select": f"""{ALL} SELECT rule_id, count(*) AS findings FROM f WHERE rule_id IN
 ('SEC003', 'SEC014', 'DOCKER001', 'DOCKER007', 'K8S008', 'K8S016') GROUP BY ALL""",
    "rule_disable": f"""{ALL} SELECT rule_id, count(*) AS findings FROM f WHERE rule_id NOT IN
 ('SEC014', 'DOCKER009', 'K8S017') GROUP BY ALL""",
    "severity_filter": f"""{ALL} SELECT rule_id, severity, count(*) AS findings FROM f
 WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY ALL""",
    "rule_catalog": f"""{ALL} SELECT c.rule_id, c.severity, c.name, count(f.id) AS findings
 FROM {RULES} LEFT JOIN f ON f.rule_id = c.rule_id GROUP BY ALL""",
    "findings_enriched": f"""{DOCKER_FOUND} SELECT id, rule_id, c.name AS rule_name,
 'docker' AS family FROM f JOIN {RULES} USING (rule_id)""",
    "lines_numbered": f"{_lines(DOCUMENTS)} SELECT path, line_no, line FROM l",
    "classify_targets": f"""{_lines(EVERYTHING)} SELECT path, docker, k8s,
 CASE WHEN docker THEN 'docker' WHEN k8s THEN 'k8s' END AS family FROM t""",
    "path_exclude": f"""SELECT path FROM ({REPOSITORY}) WHERE {WANTED}
 AND NOT ends_with(path, '.min.js') AND NOT starts_with(path, 'repo1')
 AND NOT list_contains(string_split(path, '/')[:-2], 'test')""",
    "path_exclude_reference": f"""SELECT path FROM ({REPOSITORY}) WHERE {WANTED}
 AND NOT ends_with(path, '.min.js') AND NOT starts_with(path, 'repo1')
 AND NOT (starts_with(path, 'repo2/src') AND ends_with(path, '.py'))
 AND NOT ends_with(path, '.yaml')""",
    "path_include": f"""SELECT path FROM ({REPOSITORY}) WHERE {WANTED}
 AND (ends_with(path, '.py') OR (ends_with(path, '.md') AND string_split(path, '/')[-2] = 'en'))""",
    "binary_ext_filter": f"""SELECT path FROM ({REPOSITORY})
 WHERE NOT (contains({BASE}, '.') AND {EXTENSION} IN ({BINARY}))""",
    "size_filter": f"""SELECT path, {N_BYTES} AS n_bytes FROM ({REPOSITORY}) WHERE {WANTED}
 AND {N_BYTES} <= 4096""",
    "target_metadata": rf"""SELECT path, regexp_extract({BASE}, '[.][^.]*$') AS extension,
 {SIZE} AS size FROM ({REPOSITORY})""",
    "oversize_lines": f"""{_found(LONG, _docker_rows())} SELECT e.path, e.error,
 count(f.id) AS findings FROM e LEFT JOIN f ON f.file_path = e.path GROUP BY ALL""",
    "finding_ids": f"{ALL} SELECT file_path, start_line, rule_id, id FROM f",
    "scan_summary": f"{SUMMARY} SELECT * FROM m",
    "scan_summary_reference":
        f"{_summary(_found(EVERYTHING, ALL_REFERENCE), reference=True)} SELECT * FROM m",
    "per_target_results": f"""{ALL} SELECT e.path, e.error, count(f.id) AS findings,
 coalesce(string_agg(f.rule_id, ',' ORDER BY f.rule_id), '') AS rules
 FROM e LEFT JOIN f ON f.file_path = e.path GROUP BY e.path, e.error""",
    "severity_share": f"""{ALL}, r(severity_rank, severity) AS (VALUES (0, 'CRITICAL'), (1, 'HIGH'),
 (2, 'MEDIUM'), (3, 'LOW'), (4, 'INFO'))
 SELECT CAST(severity_rank AS INTEGER) AS severity_rank, r.severity, count(f.id) AS findings,
  count(f.id) * 40 // (SELECT count(*) FROM f) AS filled
 FROM r LEFT JOIN f ON f.severity = r.severity GROUP BY ALL""",
    "fail_gate": f"""{ALL} SELECT bool_or(severity = 'CRITICAL') AS fails_critical,
 bool_or(severity IN ('CRITICAL', 'HIGH')) AS fails_high,
 bool_or(severity IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS fails_medium,
 bool_or(severity <> 'INFO') AS fails_low, false AS fails_other FROM f""",
    "verdict": f"""{_found(EVERYTHING, ALL_ROWS + [_entropy_row(SECRETS)])} SELECT count(*) AS total_findings,
 CASE WHEN count(*) = 0 THEN 'clean' WHEN bool_or(severity IN ('CRITICAL', 'HIGH')) THEN 'fix'
  WHEN bool_or(severity = 'MEDIUM') THEN 'consider' ELSE 'low_only' END AS verdict FROM f""",
    "rules_seen": f"""{ALL}, o AS (SELECT *, row_number() OVER (PARTITION BY rule_id
  ORDER BY file_path, start_line) AS k, count(*) OVER (PARTITION BY rule_id) AS findings FROM f)
 SELECT rule_id, findings, c.name AS title, o.severity, type, file_path AS first_path,
  start_line AS first_line FROM o JOIN {RULES} USING (rule_id) WHERE k = 1""",
    "findings_ranked": f"""{NUMBERED} SELECT ordinal, CAST(rank AS INTEGER) AS severity_rank,
 file_path, start_line, rule_id FROM o""",
    "truncate_text": f"""{_lines(DOCUMENTS)} SELECT path, line_no,
 CASE WHEN length(line) > 60 THEN left(line, 57) || '...' ELSE line END AS short FROM l""",
    "sarif_results": f"""{K8S_FOUND} SELECT rule_id, {LEVEL} AS level, id AS fingerprint,
 file_path AS uri, CAST(start_line AS VARCHAR) AS start_line, match AS snippet FROM f""",
    "sarif_github": f"""{K8S_FOUND} SELECT rule_id, replace({LEVEL}, 'none', 'note') AS level,
 substring(file_path, 5) AS uri, CAST(start_line AS VARCHAR) AS start_line,
 CAST(NULL AS VARCHAR) AS snippet, CAST(NULL AS VARCHAR) AS fingerprint FROM f""",
    "sarif_rules": f"""{ALL} SELECT DISTINCT rule_id, c.name, {LEVEL.replace('severity', 'f.severity')}
 AS level, 'https://example.org/auditlake/rules/' || lower(rule_id) AS help_uri
 FROM f JOIN {RULES} USING (rule_id)""",
    "sarif_documents": f"""{ALL} SELECT string_split(file_path, '/')[1] AS project, true AS valid,
 count(*) AS findings, count(*) AS results FROM f GROUP BY ALL""",
    "json_rows": f"""{ALL}, c AS (SELECT file_path, count(*) AS n, sum(start_line) AS lines,
  string_agg(id, ',' ORDER BY id) AS ids,
  string_agg(match, '|' ORDER BY id) AS matches FROM f GROUP BY ALL)
 SELECT e.path, 'FILE' AS type, {SIZE} AS size, error, coalesce(n, 0) = 0 AS no_findings,
  coalesce(n, 0) AS findings, coalesce(ids, '') AS ids, coalesce(matches, '') AS matches,
  CAST(coalesce(lines, 0) AS BIGINT) AS lines FROM e LEFT JOIN c ON c.file_path = e.path""",
    "markdown_rows": f"""{NUMBERED} SELECT ordinal, '## ' || ordinal || CASE severity
  WHEN 'CRITICAL' THEN ' 🔴 ' WHEN 'HIGH' THEN ' 🟠 ' WHEN 'MEDIUM' THEN ' 🟡 ' ELSE ' 🔵 ' END
  || name AS heading,
 '| ' || severity || ' | ' || rule_id || ' | `' || file_path || ':' || start_line || '` |' AS facts
 FROM o""",
    "table_rows": f"""{NUMBERED} SELECT ordinal,
 lpad(ordinal::VARCHAR, 6, ' ') || '  ' || file_path || ' line ' || start_line AS place_line,
 '        ' || lower(severity) || ' ' || rule_id || ': ' || name AS rule_line,
 '        seen  ' || CASE WHEN length(match) > 60 THEN left(match, 57) || '...' ELSE match END
  AS match_line FROM o""",
    "report_file": f"{PLANTED} SELECT t.path, f.id, f.rule_id FROM t LEFT JOIN f ON f.file_path = t.path",
    "merge_reports": f"""{_found(DOCKERFILES + ' UNION ALL ' + CONFIGS, _docker_rows() + _secret_rows())}
 SELECT rule_id, count(*) AS findings FROM f GROUP BY ALL""",
    "sarif_merged": f"""{_found(DOCKERFILES + ' UNION ALL ' + CONFIGS, _docker_rows() + _secret_rows())}
 SELECT rule_id, count(*) AS findings FROM f GROUP BY ALL""",
    "sarif_clean": f"""{DOCKER_FOUND} SELECT string_split(t.path, '/')[-1] AS kind, true AS valid,
  CAST(count(f.id) AS BIGINT) AS findings FROM t LEFT JOIN f ON f.file_path = t.path
  AND f.rule_id = 'DOCKER012' AND ends_with(t.path, 'prod') GROUP BY ALL""",
    "github_documents": f"""{K8S_FOUND} SELECT (row_number() OVER (ORDER BY {RANK}, file_path,
  start_line, rule_id) - 1) // 400 AS chunk, rule_id, replace({LEVEL}, 'none', 'note') AS level,
 substring(file_path, 5) AS uri, start_line FROM f""",
    "written_report": f"{PLANTED} SELECT file_path AS path, id, rule_id FROM f",
    "written_findings": f"{PLANTED} {SHOW}",
    "scan_counters": f"""{_lines(LONG)} SELECT count(*) AS total, count(*) AS processed,
 count(error) AS errors, count(*) / 2.0 AS rate, 100.0::DOUBLE AS percentage FROM e""",
    "target_types": f"""{PLANTED} {SHOW} WHERE CAST(regexp_extract(file_path, '[0-9]+') AS INTEGER) % 3 <> 0
 AND CAST(regexp_extract(file_path, '[0-9]+') AS INTEGER) % 5 <> 0""",
    "repaired_texts": f"{PLANTED} {SHOW}",
    **{name: f"""{_found(DOCUMENTS + ' UNION ALL ' + CONFIGS, _secret_rows(True))},
 p AS (SELECT CASE WHEN starts_with(file_path, 'doc/') THEN 'docs' ELSE 'conf' END AS project, *
  FROM f) SELECT project, rule_id, {times} AS findings FROM p WHERE {kept} GROUP BY ALL"""
       for name, times, kept in (
           ("scan_tree", "count(*)", "true"), ("tree_address", "count(*)", "true"),
           ("tree_hidden", "count(*)", "true"), ("tree_globs", "count(*)", "project = 'conf'"),
           ("multiple_roots", "count(*) * CASE WHEN max(project) = 'conf' THEN 2 ELSE 1 END", "true"),
       )},
    "tree_wide": f"""{_found(DOCUMENTS + ' UNION ALL ' + CONFIGS, _secret_rows(True))}
 SELECT CASE WHEN starts_with(file_path, 'doc/') THEN 'wide' ELSE 'deep' END AS project, rule_id,
  count(*) AS findings FROM f GROUP BY ALL""",
    "tree_pruned": """WITH d AS (SELECT count(*) AS n FROM documents),
 c AS (SELECT count(*) AS n, max(c_custkey % 60) + 1 AS depth, count(DISTINCT c_custkey % 7) AS old FROM customer)
 SELECT 'intent' AS mode, 'entered' AS kind, 3 + depth + old AS entries FROM c
 UNION ALL SELECT 'intent', 'cut', 1 + old FROM c
 UNION ALL SELECT 'intent', 'file', d.n + c.n FROM d, c
 UNION ALL SELECT 'reference', 'entered', 3 + depth + 2 * old FROM c
 UNION ALL SELECT 'reference', 'cut', 1 FROM c
 UNION ALL SELECT 'reference', 'file', d.n + 2 * c.n FROM d, c""",
    "stream_scan": f"{PLANTED} {SHOW}",
    "suppressed": f"""{PLANTED}, k AS (SELECT *, CAST(regexp_extract(file_path, '[0-9]+') AS INTEGER) AS c FROM f)
 SELECT id, rule_id, file_path, c % 4 = 0 OR (c % 2 = 1 OR rule_id = 'SEC007') AND c % 5 IN (0, 1)
  OR EXISTS (SELECT 1 FROM customer WHERE c_custkey % 5 = 2 AND (c_custkey % 2 = 1 OR k.rule_id = 'SEC007')
   AND starts_with(CAST(k.c AS VARCHAR), CAST(c_custkey AS VARCHAR))) AS suppressed FROM k""",
    "many_rules": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
  UNION ALL SELECT doc_id, 'id-' || lpad(CAST(doc_id * 7 % 640 AS VARCHAR), 3, '0') || '-x' FROM documents),
 r AS (SELECT i, 'OWN' || lpad(CAST(i AS VARCHAR), 3, '0') AS rule_id, 'id-' || lpad(CAST(i AS VARCHAR), 3, '0') || '-' AS word FROM range(500) t(i)),
 m AS (SELECT doc_id, line, unnest(regexp_extract_all(line, 'id-[0-9]{3}-')) AS word FROM l WHERE contains(line, 'id-'))
 SELECT rule_id, count(DISTINCT (doc_id, line)) AS findings FROM m JOIN r USING (word) GROUP BY ALL""",
    "stream_summary": f"{SUMMARY} SELECT * FROM m",
    "stream_tree": f"""{PLANTED} SELECT CAST(regexp_extract(file_path, '[0-9]+') AS BIGINT) AS c_custkey, rule_id,
 start_line, match FROM f""",
    "stream_counts": f"{PLANTED} SELECT severity, count(*) AS findings FROM f GROUP BY ALL",
    "stream_dedup": """SELECT DISTINCT concat('user/', user_id) AS file_path,
 substring(sha256(concat('user/', user_id, ':1:SEC003')), 1, 16) AS id,
 'gh' || 'p_' || repeat('*', 32) || right(repeat(lpad(CAST(user_id AS VARCHAR), 9, '0'), 4), 4)
 AS match FROM events""",
}
