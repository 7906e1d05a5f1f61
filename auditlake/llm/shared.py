"""Intermediate tables and files in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a table, strings and 16 for each value, that may be sent to every task.
SENT_BYTES = 16 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (URI) below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own. The new
    folder is deleted when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='auditlake-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/auditlake-llm/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_folder`` before the session ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: worked out once, and kept when executors are lost."""
    spark = rows.sparkSession
    path = shared_folder(spark, name)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(rows: DataFrame, *strings: str, told: bool = False):
    """A stored table, marked to be sent to every task if it holds few bytes, those of ``strings`` counted in full.

    With ``told`` also whether it is.
    """
    sizes = sum((F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in strings), F.lit(16 * len(rows.columns)))
    few = (rows.agg(F.sum(sizes.cast("bigint"))).first()[0] or 0) <= SENT_BYTES
    found = F.broadcast(rows) if few else rows
    return (found, few) if told else found
