"""The same scan over streams; nothing here keeps state but what is asked for.

Running totals are kept as a ledger of written tables, one per batch, each the one before it plus its
own batch. A batch that is replayed after a crash writes its table anew from the same predecessor, so it
is counted once; readers take the last table that is whole.

A file tree is streamed by way of a log: each pass walks the tree and appends the files that the log
does not hold yet, or holds with another size or time, and the stream reads the log. The log is a
Parquet table, so its own position in it is all that a restarted stream needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from auditlake.model import INTENT, ScanOptions
from auditlake.operators.match import find
from auditlake.operators.summary import SUMMARY_COLUMNS, summarize
from auditlake.sources import tree

# Tables of running totals that are kept behind the last one.
KEPT = 2
LOG_SCHEMA = "path string, shown string, size bigint, modified bigint"


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Rows of a Parquet folder as files arrive."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_findings(
    targets: DataFrame, options: ScanOptions | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Findings of a stream of targets: the batch operator as it is.

    ``carry`` names columns to keep beside the findings, such as a time of arrival.
    """
    return find(targets, options, carry)


def running_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity so far; the state is one row per severity."""
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def drop_repeats(findings: DataFrame, arrival: str, within: str) -> DataFrame:
    """Each finding once in a span of arrival time, known by its identifier."""
    return findings.withWatermark(arrival, within).dropDuplicatesWithinWatermark(["id"])


def write_findings(findings: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append findings to a Parquet folder, each file once, until input runs out."""
    return (
        findings.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_counts(
    counts: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand the running totals to ``save`` after each batch."""
    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


# --- running totals ---------------------------------------------------------------------


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose totals are whole, from the first to the last."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    names = [s.getPath().getName() for s in store.listStatus(where)]
    numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    return sorted(n for n in numbers if store.exists(path(f"{folder}/batch={n}/_SUCCESS")))


def add_totals(totals: DataFrame, batch: int, folder: str) -> None:
    """Write the totals up to ``batch``: one row of ``totals`` plus those up to the batch before.

    Writing it again, after a crash or a replay, gives the same row.
    """
    spark = totals.sparkSession
    known = [n for n in _batches(spark, folder) if n < batch]
    every = totals.select(*SUMMARY_COLUMNS)
    if known:
        every = every.unionByName(spark.read.parquet(f"{folder}/batch={known[-1]}").select(*SUMMARY_COLUMNS))
    summed = every.agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMMARY_COLUMNS))
    summed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for old in known[:-KEPT]:
        where = path(f"{folder}/batch={old}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_summary(results: DataFrame, folder: str, checkpoint: str, mode: str = INTENT) -> StreamingQuery:
    """Keep the summary of a stream of per-target results up to date in ``folder``, until input runs out.

    One folder belongs to one checkpoint.
    """

    def save(batch: DataFrame, number: int) -> None:
        add_totals(summarize(batch, mode), number, folder)

    return (
        results.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary up to the last whole batch: one row, zeros before the first."""
    known = _batches(spark, folder)
    if known:
        return spark.read.parquet(f"{folder}/batch={known[-1]}").select(*SUMMARY_COLUMNS)
    return spark.range(1).select(*(F.lit(0).cast("bigint").alias(c) for c in SUMMARY_COLUMNS))


# --- file trees -------------------------------------------------------------------------


def extend_log(spark: SparkSession, root: str, log: str, options: ScanOptions | None = None) -> int:
    """Append the files of a tree that the log lacks, or that have changed; how many there were.

    Files that are gone stay in the log and are left out when they are read.
    """
    found = tree.chosen(spark, root, options or ScanOptions(), dated=True).select("path", "shown", "size", "modified")
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        held = spark.read.schema(LOG_SCHEMA).parquet(log).select("path", "size", "modified")
        found = found.join(held, ["path", "size", "modified"], "left_anti")
    found = tree.stored(found, "new-files")
    count = found.count()
    if count:
        found.write.mode("append").parquet(log)
    return count


def stream_tree(
    spark: SparkSession, root: str, log: str, options: ScanOptions | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Targets of a tree, hidden names included, as its log grows; see ``extend_log``."""
    rows = stream_table(spark, log, LOG_SCHEMA, files_per_trigger=files_per_trigger)
    return tree.read_listed(rows, root)
