"""Walking file trees in rounds of tasks.

Each round lists the folders found by the one before, spread anew over all tasks. A task walks on below
a folder of its own for up to ``STEP`` entries and hands back the folders left, so that a deep chain
needs few rounds and a bushy tree is shared out early. Names of a folder are handed on in pages as they
are read; files of mounted paths are looked up afterwards, spread by path, so that one huge folder is
read by one task but looked up by all. Every round is a written table: a lost executor repeats its own
folders, and the driver holds nothing but the number of folders still open.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.prune import Pruner
from auditlake.operators.order import stored
from auditlake.operators.paths import EXCLUDED_NAMES

# Entries a task looks at below one folder before it hands the rest back; rows put out at once.
STEP, PAGE = 5_000, 10_000
# Tasks of a round for each folder still open, so that few folders seldom share one.
TASKS_A_FOLDER = 4
# What a row of a listing is: a file, a folder that was entered, one left for the next round, one that
# the globs cut off, one that could not be read.
FILE, ENTERED, OPEN, CUT, UNREADABLE = "file", "entered", "open", "cut", "unreadable"
LISTING_SCHEMA = "kind string, path string, size bigint"
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:/")


@dataclass(frozen=True)
class Entry:
    """A name in a folder; only stores know the size without another look."""

    name: str
    path: str
    is_folder: bool
    size: int | None = None


@dataclass(frozen=True)
class Root:
    """A root as tasks open it, and how globs spell what lies below it."""

    opened: str
    spelt: str | None = None
    pruner: Pruner | None = None

    def store(self) -> tuple[fs.FileSystem | None, str]:
        found = store_of(self.opened)
        return found if found else (None, self.opened)

    def enters(self, top: str, folder: str) -> bool:
        if self.pruner is None:
            return True
        below = folder[len(top):].lstrip("/")
        if self.spelt is None:
            return self.pruner.enters(below)
        return self.pruner.enters(below if self.spelt == "." else f"{self.spelt}/{below}".rstrip("/"))


def store_of(root: str) -> tuple[fs.FileSystem, str] | None:
    """File system and path of an address; ``None`` for a mounted path."""
    return fs.FileSystem.from_uri(root) if _SCHEME.match(root) else None


def entries(folder: str, store: fs.FileSystem | None = None) -> Iterator[Entry]:
    """What lies in a folder; an ``OSError`` if it cannot be read."""
    if store is not None:
        for info in store.get_file_info(fs.FileSelector(folder)):
            yield Entry(info.base_name, info.path, info.type == fs.FileType.Directory, info.size)
        return
    with os.scandir(folder) as found:
        for entry in found:
            yield Entry(entry.name, entry.path, entry.is_dir(follow_symlinks=False))


def status_of(path: str, follow: bool) -> tuple[int, int] | None:
    """Size of a regular file and when it was changed, in nanoseconds; ``None`` for what is not read."""
    try:
        info = os.lstat(path)
        if stat.S_ISLNK(info.st_mode):
            if not follow:
                return None
            info = os.stat(path)
        return (info.st_size, info.st_mtime_ns) if stat.S_ISREG(info.st_mode) else None
    except OSError:
        return None


def _walk_below(folder: str, root: Root, store: fs.FileSystem | None, top: str, step: int = STEP) -> Iterator[tuple[str, str, int | None]]:
    left, seen = [folder], 0
    while left:
        if seen >= step:
            yield from ((OPEN, path, None) for path in left)
            return
        at = left.pop()
        try:
            for entry in entries(at, store):
                seen += 1
                if entry.name in EXCLUDED_NAMES:
                    continue
                if not entry.is_folder:
                    yield FILE, entry.path, entry.size
                elif root.enters(top, entry.path):
                    left.append(entry.path)
                else:
                    yield CUT, entry.path, None
            yield ENTERED, at, None
        except OSError:
            yield UNREADABLE, at, None


def _paged(rows: Iterator[tuple[str, str, int | None]]) -> Iterator[pa.RecordBatch]:
    page: list[tuple[str, str, int | None]] = []

    def put() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*page, strict=True), kinds, strict=True)], names=["kind", "path", "size"])

    for row in rows:
        page.append(row)
        if len(page) == PAGE:
            yield put()
            page = []
    if page:
        yield put()


def _listed(root: Root, step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, top = root.store()
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            yield from _paged(_walk_below(folder, root, store, top, step))


def _looked_up(root: Root, follow: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, _ = root.store()
    for batch in batches:
        paths = batch.column("path").to_pylist()
        if store is None:
            known = [status_of(path, follow) for path in paths]
        else:
            known = [(i.size, i.mtime_ns or 0) if i.type == fs.FileType.File else None for i in store.get_file_info(paths)]
        sizes, times = (pa.array([k and k[n] for k in known], pa.int64()) for n in (0, 1))
        found = pa.RecordBatch.from_arrays([batch.column("path"), sizes, times], names=["path", "size", "modified"])
        yield found.filter(sizes.is_valid())


def walk(spark: SparkSession, root: Root, tasks: int | None = None, step: int = STEP) -> DataFrame:
    """``(kind, path, size)`` of all that a walk finds below a root; sizes only where a store knows them.

    ``step`` is the number of entries below one folder after which a task hands back the rest.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store, top = root.store()
    row = None
    if os.path.basename(top.rstrip("/")) in EXCLUDED_NAMES:
        return spark.createDataFrame([], LISTING_SCHEMA)
    if store is not None:
        if store.get_file_info(top).type != fs.FileType.Directory:
            row = (FILE, top, store.get_file_info(top).size)
    elif not os.path.isdir(top) or os.path.islink(top):
        row = (FILE, top, None)
    if row is None:
        row = (OPEN if root.enters(top, top) else CUT, top, None)
    rounds = [spark.createDataFrame([row], LISTING_SCHEMA)]
    while True:
        left = rounds[-1].filter(F.col("kind") == OPEN).select("path")
        folders = left.count()
        if not folders:
            return reduce(DataFrame.unionByName, rounds).filter(F.col("kind") != OPEN)
        # A round of a deep chain has a folder or two: it needs no more tasks than they can keep busy.
        spread = left.repartition(min(tasks, TASKS_A_FOLDER * folders), "path")
        found = spread.mapInArrow(partial(_listed, root, step), LISTING_SCHEMA)
        rounds.append(stored(found, "listing"))


def files(listing: DataFrame, root: Root, follow: bool = False, tasks: int | None = None, dated: bool = False) -> DataFrame:
    """``(path, size)`` of the regular files of a listing, looked up by all tasks; with ``dated`` also ``modified``."""
    tasks = tasks or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = listing.filter(F.col("kind") == FILE).select("path", "size")
    if root.store()[0] is not None and not dated:
        return found.filter("size IS NOT NULL")
    looked = found.select("path").repartition(tasks, "path")
    rows = looked.mapInArrow(partial(_looked_up, root, follow), "path string, size bigint, modified bigint")
    return rows if dated else rows.drop("modified")


def counts(listing: DataFrame) -> DataFrame:
    """How many files, folders entered, cut off and unreadable a walk met: ``(kind, entries)``."""
    return listing.groupBy("kind").agg(F.count("*").alias("entries"))
