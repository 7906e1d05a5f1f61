"""Targets from file trees.

``read_tree`` reads every file of a tree, also the ones whose names begin with
a dot or an underscore, which Spark's file sources leave out. Folders are listed
in rounds of tasks, and globs cut the walk short where they can. A root is a path
that is mounted on the executors, or the address of a store that ``pyarrow.fs``
opens there (``hdfs://``, ``s3://``, ``gs://``, ``file://``); tasks list and read
it. ``read_binary`` is Spark's own source, for any file system Spark knows but
without those names, without empty files (which have no findings), with links
followed, and with contents read before paths are filtered.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.functions.prune import Pruner
from auditlake.model import FILE, REFERENCE, ScanOptions
from auditlake.operators.order import stored
from auditlake.operators.paths import wanted_path
from auditlake.sources import walk
from auditlake.sources.tables import file_metadata, with_longest_line
from auditlake.sources.walk import Root, store_of

# Bytes of file content, and files, one task hands to Spark at a time.
_BATCH_BYTES, _BATCH_FILES = 32 * 1024 * 1024, 10_000


def _checked(root: str) -> str:
    """A root as tasks open it: an address, or an absolute path; one that is not there is an error."""
    found = store_of(root)
    if found:
        store, path = found
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such root: {root}")
        return root.rstrip("/")
    if not os.path.lexists(root):
        raise FileNotFoundError(f"no such root: {root}")
    return os.path.abspath(root)


def _spelling(root: str, opened: str) -> str:
    """The root as a walk spells it."""
    store = store_of(opened)
    return store[1].rstrip("/") if store else os.path.normpath(root)


def root_of(root: str, options: ScanOptions | None = None) -> Root:
    """A root for ``walk.walk``, with the globs that may cut the walk short."""
    opened = _checked(root)
    if options is None:
        return Root(opened)
    pruner = Pruner(options.excludes, options.includes, options.mode)
    return Root(opened, _spelling(root, opened) if options.mode == REFERENCE else None, pruner)


def list_tree(
    spark: SparkSession, root: str, follow_symlinks: bool = False, options: ScanOptions | None = None,
    dated: bool = False,
) -> DataFrame:
    """One row per file below ``root``, without folders that the globs of ``options`` cut off.

    ``path`` is where tasks read it, ``name`` the path from the root's base
    name, ``below`` the one below the root, and ``spelt`` the path as a walk
    from the root as it was given spells it. The folders are listed at once
    (see ``sources.walk``), files are looked up when the rows are read.
    """
    start = root_of(root, options)
    files = walk.files(walk.walk(spark, start), start, follow_symlinks, dated=dated)
    return _named(files, root, start.opened)


def _named(listing: DataFrame, root: str, opened: str) -> DataFrame:
    store = store_of(opened)
    top = (store[1] if store else opened).rstrip("/")
    base = os.path.basename(top)
    # A root that is a file is its own only entry.
    below = F.expr(f"if(length(path) = {len(top)}, {_sql(base)}, substr(path, {len(top) + 2}))")
    given = _spelling(root, opened)
    spelt = F.expr(f"substr(path, {len(top) + 2})") if given == "." else F.concat(
        F.lit(given), F.expr(f"substr(path, {len(top) + 1})")
    )
    return listing.withColumns({
        "name": F.concat(F.lit(base), F.expr(f"substr(path, {len(top) + 1})")),
        "below": below,
        "spelt": spelt,
    })


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _read_files(root: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of listed files; files that cannot be read are left out."""
    paths: list[str] = []
    sizes: list[int] = []
    bodies: list[bytes] = []
    held, store = 0, store_of(root)

    def flush() -> pd.DataFrame:
        return pd.DataFrame({"path": paths, "size": sizes, "content": bodies})

    for batch in batches:
        for path, name, size in zip(batch["path"], batch["shown"], batch["size"]):
            try:
                with store[0].open_input_stream(path, compression=None) if store else open(path, "rb") as file:
                    body = file.read()
            except OSError:
                continue
            paths.append(name)
            sizes.append(size)
            bodies.append(body)
            held += len(body)
            if held >= _BATCH_BYTES or len(paths) >= _BATCH_FILES:
                yield flush()
                paths, sizes, bodies, held = [], [], [], 0
    if paths:
        yield flush()


def read_tree(
    spark: SparkSession,
    roots: str | Iterable[str],
    options: ScanOptions | None = None,
    follow_symlinks: bool = False,
    readers: int | None = None,
) -> DataFrame:
    """Targets of all files below the roots that the options keep.

    In intent mode globs are tried on the path below the root, and targets are
    named by their absolute path; in reference mode both go by the path as a
    walk spells it. The listing is filtered first and then spread over
    ``readers`` tasks by path, so a folder with most of the files is still read
    by all of them. Roots that overlap give their common files more than once;
    a root that does not exist is an error.
    """
    options = options or ScanOptions()
    roots = [roots] if isinstance(roots, str) else list(roots)
    return reduce(DataFrame.unionByName, (
        read_listed(chosen(spark, root, options, follow_symlinks), root, readers) for root in roots
    ))


def chosen(
    spark: SparkSession, root: str, options: ScanOptions, follow_symlinks: bool = False, dated: bool = False
) -> DataFrame:
    """The files of a tree that the options keep, with ``shown``, the path targets are named by."""
    reference = options.mode == REFERENCE
    tried = F.col("spelt" if reference else "below")
    wanted = wanted_path(F.col("name"), options.excludes, options.includes, options.mode, tried)
    listed = list_tree(spark, root, follow_symlinks, options, dated)
    kept = listed.filter(wanted & (F.col("size") <= options.max_file_bytes))
    return kept.withColumn("shown", F.col("spelt" if reference else "path"))


def read_listed(listed: DataFrame, root: str, readers: int | None = None) -> DataFrame:
    """Targets from rows ``(path, shown, size)`` of files below a root, read by ``readers`` tasks."""
    readers = readers or int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = listed.select("path", "shown", "size").repartition(readers, "path")
    bodies = partial(_read_files, _checked(root))
    return _as_targets(spread.mapInPandas(bodies, "path string, size bigint, content binary"))


def read_binary(
    spark: SparkSession, root: str, options: ScanOptions | None = None, glob: str | None = None
) -> DataFrame:
    """Targets from Spark's ``binaryFile`` source, for HDFS and object stores.

    The size test is pushed into the source. Paths lose their scheme, so that
    identifiers do not change with the way a root is mounted.
    """
    options = options or ScanOptions()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).filter(F.col("length") <= options.max_file_bytes)
    path = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    trimmed = root.rstrip("/").split("://")[-1]
    above = len(trimmed) - len(os.path.basename(trimmed))
    named = files.select(path.alias("path"), F.col("length").alias("size"), "content")
    kept = wanted_path(
        F.expr(f"substr(path, 1 + {above})"), options.excludes, options.includes, options.mode
    )
    return _as_targets(named.filter(kept))


def _as_targets(read: DataFrame) -> DataFrame:
    longest = text.longest_line(F.col("content"))
    return read.select(
        "path",
        F.lit(FILE).alias("type"),
        text.decode(F.col("content")).alias("content"),
        with_longest_line(file_metadata("path", "size"), longest).alias("metadata"),
    )
