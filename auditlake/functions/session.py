"""Where a job may put data that all executors can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names, deleted when the session's JVM ends.

    The folder comes from ``spark.checkpoint.dir``, or else from the checkpoint
    folder set on the context. Without either, only a local session may go on:
    it gets a checkpoint folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='auditlake-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/auditlake/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path
