"""Scan options from the mapping of a configuration file."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from auditlake.model import CONFIG_EXCLUDES, INTENT, MAX_FILE_BYTES, ScanOptions
from auditlake.operators.catalog import rules_from_config

_UNITS = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


@dataclass(frozen=True)
class Config:
    """A scan and what is done with it."""

    options: ScanOptions
    follow_symlinks: bool = False
    format: str = "table"
    output: str | None = None
    verbose: bool = False
    fail_on: str = "high"


def size_in_bytes(text: str) -> int:
    """A size such as ``10MB``, in powers of 1024."""
    found = re.fullmatch(r"\s*(\d+)\s*([KMG]?B)?\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a size: {text}")
    return int(found.group(1)) * _UNITS[(found.group(2) or "").upper()]


def read_config(config: Mapping[str, Any], mode: str = INTENT) -> Config:
    """Options from the ``scan``, ``rules``, ``output`` and ``ci`` sections.

    Missing settings have their defaults. Worker counts and timeouts are left
    to the cluster.
    """
    scan, rules = config.get("scan") or {}, config.get("rules") or {}
    output, ci = config.get("output") or {}, config.get("ci") or {}
    limit = scan.get("max_file_size")
    options = ScanOptions(
        mode=mode,
        excludes=tuple(CONFIG_EXCLUDES if scan.get("exclude") is None else scan["exclude"]),
        includes=tuple(scan.get("include") or ()),
        max_file_bytes=size_in_bytes(limit) if limit else MAX_FILE_BYTES,
        enabled_rules=tuple(rules.get("enabled") or ()),
        disabled_rules=tuple(rules.get("disabled") or ()),
        custom_rules=rules_from_config(rules.get("custom") or ()),
    )
    return Config(
        options,
        follow_symlinks=bool(scan.get("follow_symlinks", False)),
        format=output.get("format", "table"),
        output=output.get("file") or None,
        verbose=bool(output.get("verbose", False)),
        fail_on=ci.get("fail_on", "high"),
    )
