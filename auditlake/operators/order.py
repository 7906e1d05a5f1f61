"""Order and numbering of findings without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.session import shared_path
from auditlake.model import SEVERITIES

ORDER = ("severity_rank", "file_path", "start_line", "rule_id")
# Rows of one partition have consecutive numbers above this bit.
_POSITION_BITS = 33


def severity_rank(severity: Column) -> Column:
    rank = F.when(severity == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], start=1):
        rank = rank.when(severity == name, i)
    return rank.otherwise(len(SEVERITIES)).cast("int")


def with_rank(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_rank", severity_rank(F.col("severity")))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as written to the shared folder, so that they are found once.

    A range sort looks at its input twice, first to choose the ranges; without
    this it would scan all texts twice. Findings are small next to the texts.
    """
    path = shared_path(rows.sparkSession, name)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by severity, path, line and rule, over range partitions."""
    kept = stored(with_rank(findings), "findings")
    tied = kept.withColumn("tie", F.monotonically_increasing_id())
    return tied.orderBy(*ORDER, "tie").drop("tie")


def placed(rows: DataFrame, *columns: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows in a total order with their ``part`` and ``position`` within it.

    The row's own number breaks ties, so that range partitions can cut between
    the rows of one key, and even between copies of one row. Columns too long
    to choose ranges by, whose sample the driver gathers, go ``within``: they
    order the rows of one key, which then stay in one partition.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    tied = stored(rows, "findings").withColumn("tie", F.monotonically_increasing_id())
    return (
        tied.repartitionByRange(*columns, *(() if within else ("tie",)))
        .sortWithinPartitions(*columns, *within, "tie")
        .withColumns({"part": F.spark_partition_id(), "position": position})
        .drop("tie")
    )


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with their ordinal in report order, from one.

    The order is written once, so that counts and rows come from the same
    partitions. Partition counts, one row per partition, are what is collected
    into the running offsets and sent to every task.
    """
    rows = stored(placed(with_rank(findings), *ORDER), "ordered")
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return (
        rows.join(F.broadcast(offsets), "part")
        .withColumn("ordinal", (F.col("offset") + F.col("position") + 1).cast("bigint"))
        .drop("part", "position", "offset")
    )
