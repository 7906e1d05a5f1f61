"""Path, size and type filters; all run before any text is read or matched."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.regex import glob_pattern
from auditlake.model import FILE, INTENT, MAX_FILE_BYTES

# Base names that are never entered or read.
EXCLUDED_NAMES = (
    ".git", ".svn", ".hg", "node_modules", "vendor", "__pycache__", ".venv", "venv",
    ".idea", ".vscode", "dist", "build", "target", ".terraform",
)

# Extensions of files taken for binary.
BINARY_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".db", ".sqlite",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg",
    ".mp3", ".mp4", ".avi", ".mov",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz",
    ".woff", ".woff2", ".ttf", ".eot", ".lock", ".sum",
)


def _any_of(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def excluded_by_name(path: Column) -> Column:
    """Whether the path or a directory above it has an excluded base name."""
    names = F.array(*[F.lit(n) for n in EXCLUDED_NAMES])
    return F.arrays_overlap(F.split(path, "/", -1), names)


def excluded_by_glob(path: Column, globs: Iterable[str], mode: str = INTENT) -> Column:
    patterns = (glob_pattern(g, mode, ancestors=True) for g in globs)
    return _any_of(path.rlike(p) for p in patterns if p)


def included_by_glob(path: Column, globs: Iterable[str], mode: str = INTENT) -> Column:
    patterns = (glob_pattern(g, mode, ancestors=False) for g in globs)
    return _any_of(path.rlike(p) for p in patterns if p)


def is_binary_name(path: Column) -> Column:
    """Whether the base name's extension, its last dot on, is a binary one."""
    base = F.substring_index(path, "/", -1)
    extension = F.concat(F.lit("."), F.lower(F.substring_index(base, ".", -1)))
    return base.contains(".") & extension.isin(*BINARY_EXTENSIONS)


def wanted_path(
    path: Column,
    excludes: Iterable[str] = (),
    includes: Iterable[str] = (),
    mode: str = INTENT,
    tried: Column | None = None,
) -> Column:
    """The walker's tests on a path taken together; no includes means all.

    Globs are tried on ``tried``, by default the path itself.
    """
    tried = path if tried is None else tried
    excludes, includes = tuple(excludes), tuple(includes)
    keep = ~excluded_by_name(path) & ~is_binary_name(path)
    if excludes:
        keep = keep & ~excluded_by_glob(tried, excludes, mode)
    if includes:
        keep = keep & included_by_glob(tried, includes, mode)
    return keep


def filter_targets(
    targets: DataFrame,
    excludes: Iterable[str] = (),
    includes: Iterable[str] = (),
    mode: str = INTENT,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Keep the targets a walk over the same paths would have read."""
    return (
        targets.filter(F.col("type") == FILE)
        .filter(wanted_path(F.col("path"), excludes, includes, mode))
        .filter(F.octet_length("content") <= max_bytes)
    )
