"""One report in one file, put together from parts that tasks write.

The rows of a report are dealt to range partitions, and each partition is written as a part, with the
sign that separates rows before every row but the very first. Head and tail are parts of their own.
A store that can concatenate files (``fs.capability.paths.concat``, as HDFS) joins the parts without
reading them; for others one task copies them, a block at a time, to the end of the file. Neither the
report nor a part passes through the driver, which knows the names of the parts only. The parts lie in
a folder beside the file, and the file gets its name when it is whole: a job that is cut short leaves
no half report, and a repeated one begins anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.order import placed, stored

_CAN_JOIN = "fs.capability.paths.concat"
_BLOCK = 8 << 20


def _written(spark: SparkSession, folder: str, name: str, value: str) -> str:
    """A part of a few lines."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return f"{folder}/{name}"


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """The part files of a folder, in the order of partitions; empty ones hold nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    found = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in listed]
    return [path for name, path, size in sorted(found) if name.startswith("part-") and size]


def _copied(parts: list[str], target: str):
    """A function for one task: the parts, one after the other, into a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 0
        for _ in batches:
            store, path = fs.FileSystem.from_uri(target)
            with store.open_output_stream(path) as out:
                for part in parts:
                    source, name = fs.FileSystem.from_uri(part)
                    with source.open_input_stream(name, compression=None) as held:
                        while block := held.read(_BLOCK):
                            out.write(block)
                            size += len(block)
        yield pd.DataFrame({"bytes": [size]})

    return run


def write_single(rows: DataFrame, path: str, *order: str, value: Column, head: str = "", tail: str = "", between: str = "") -> None:
    """Write ``head``, one line of ``value`` per row in the given order, and ``tail`` as the file ``path``.

    ``between`` stands before every row but the first. A file that is there already is replaced.
    """
    spark = rows.sparkSession
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    work = f"{path}.{uuid.uuid4().hex}.parts"
    lines = rows.select(*(F.col(c) for c in order), value.alias("_value"))
    runs = placed(lines, *order)
    if between:
        # The first row is the first of the first partition that has any.
        runs = stored(runs, "report-lines")
        least = runs.agg(F.min("part")).first()[0]
        first = (F.col("part") == F.lit(least)) & (F.col("position") == 0)
        runs = runs.withColumn("_value", F.when(first, F.col("_value")).otherwise(F.concat(F.lit(between), F.col("_value"))))
    runs.select(F.col("_value").alias("value")).write.text(f"{work}/body")
    named = [("head", head)] * bool(head), [("tail", tail)] * bool(tail)
    ends = [[p for name, text in some for p in _parts(spark, _written(spark, work, name, text))] for some in named]
    parts = [*ends[0], *_parts(spark, f"{work}/body"), *ends[1]]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target, store = jvm_path(path), jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = jvm_path(f"{work}/whole")
    if parts and store.hasPathCapability(target, _CAN_JOIN):
        whole = jvm_path(parts[0])
        others = [jvm_path(p) for p in parts[1:]]
        array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(others))
        for i, other in enumerate(others):
            array[i] = other
        if others:
            store.concat(whole, array)
    else:
        one = spark.createDataFrame([(1,)], "n int").coalesce(1)
        one.mapInPandas(_copied(parts, whole.toString()), "bytes bigint").collect()
    store.delete(target, False)
    if not store.rename(whole, target):
        raise OSError(f"cannot name the report {path}")
    store.delete(jvm_path(work), True)
