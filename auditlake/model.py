"""Data model: severities, record schemas and scan options."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Severities in rank order (rank 0 sorts first, anything else is 5).
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
DEFAULT_SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# Finding and target types.
SECRET = "SECRET"
MISCONFIGURATION = "MISCONFIGURATION"
FILE = "FILE"

# Names a rule list is compared with in reference mode.
SECRET_SCANNER = "secret-scanner"
MISCONFIG_SCANNER = "misconfig-scanner"

# Default exclude globs of a scan and of a configuration file.
DEFAULT_EXCLUDES = (
    "**/node_modules/**",
    "**/.git/**",
    "**/vendor/**",
    "**/*.min.js",
    "**/*.min.css",
)
CONFIG_EXCLUDES = (
    "**/node_modules/**",
    "**/.git/**",
    "**/vendor/**",
    "**/dist/**",
    "**/build/**",
    "**/*.min.js",
    "**/*.min.css",
    "**/package-lock.json",
    "**/yarn.lock",
)

MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_LINE_BYTES = 64 * 1024
LONG_LINE_ERROR = "line too long"

TARGET_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("match", T.StringType()),
        T.StructField("remediation", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
FINDING_COLUMNS = tuple(FINDING_SCHEMA.fieldNames())

INTENT = "intent"
REFERENCE = "reference"


@dataclass(frozen=True)
class ScanOptions:
    """Parameters of one scan.

    ``mode`` is ``"intent"`` (rules and options do what they document) or
    ``"reference"`` (they do what the original program does).
    ``gate`` picks how targets without any secret are ruled out before their
    text is split into lines: ``"arrow"``, ``"builtin"`` or ``"none"``. The
    findings are the same for all three. ``own_scanners`` (see
    ``operators.extend.ColumnScanner``) look at each target in the same pass.
    """

    scanners: tuple[str, ...] = ("all",)
    mode: str = INTENT
    excludes: tuple[str, ...] = DEFAULT_EXCLUDES
    includes: tuple[str, ...] = ()
    enabled_rules: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    max_file_bytes: int = MAX_FILE_BYTES
    max_line_bytes: int | None = MAX_LINE_BYTES
    entropy: bool = False
    gate: str = "arrow"
    scan_time: dt.datetime | None = None
    custom_rules: tuple = field(default_factory=tuple)
    own_scanners: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if self.mode not in (INTENT, REFERENCE):
            raise ValueError(f"unknown mode: {self.mode}")
        if self.gate not in ("arrow", "builtin", "none"):
            raise ValueError(f"unknown gate: {self.gate}")

    @property
    def scanner_families(self) -> tuple[str, ...]:
        """Rule families of the chosen scanners; none chosen is an error."""
        chosen = {s.lower() for s in self.scanners}
        families = ()
        if chosen & {"all", "secrets"}:
            families += ("secret",)
        if chosen & {"all", "misconfig"}:
            families += ("docker", "k8s")
        if not families:
            raise ValueError("no scanners enabled")
        return families + ("custom",)
