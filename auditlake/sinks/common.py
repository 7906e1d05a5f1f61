"""What report formats share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.order import ORDER, placed, stored, with_rank

# Findings in one report document; a group with more gets several documents.
DOCUMENT_SIZE = 5_000
# Pieces of groups, a row each, whose offsets are sent to every task; those of more are joined by an exchange.
SENT_PIECES = 100_000

# Lengths texts are cut to in a table report.
MATCH_WIDTH, DESCRIPTION_WIDTH, REMEDIATION_WIDTH = 60, 70, 65


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def documents(
    findings: DataFrame,
    group: str,
    build: Callable[[Column], Column],
    size: int = DOCUMENT_SIZE,
    groups: DataFrame | None = None,
) -> DataFrame:
    """One document per group, or several for a group of over ``size`` findings.

    Findings are put in order over range partitions first and cut into runs of
    ``size`` by their number within the group, so a group with most of the
    findings is spread over many tasks, no task gathers more than one run, and
    the cut does not depend on the partitions. ``groups`` names groups that get
    a document even without findings. Columns: the group, ``chunk`` (from 0),
    ``chunks`` (how many the group has), ``findings`` and ``document``.
    """
    named = [c for c in findings.columns if c not in (group, "metadata")]
    runs = stored(placed(with_rank(findings), group, *ORDER), "ordered")
    # A partition is sorted by group first, so a group's rows in it follow each other.
    pieces = stored(runs.groupBy(group, "part").agg(
        F.min("position").alias("first"), F.count("*").alias("count")
    ), "report-pieces")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(group)
    offsets = pieces.select(
        F.col(group).alias("_group"), "part",
        (F.coalesce(F.sum("count").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("count").over(every).alias("total"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (runs["part"] == offsets["part"])
    numbered = runs.join(F.broadcast(offsets) if pieces.count() <= SENT_PIECES else offsets, same).withColumn("number", F.col("position") + F.col("offset"))
    cut = numbered.withColumns({
        "chunk": F.floor(F.col("number") / size), "chunks": F.ceil(F.col("total") / size),
    })
    gathered = cut.groupBy(group, "chunk", "chunks").agg(
        F.sort_array(F.collect_list(F.struct("number", F.struct(*named).alias("f")))).alias("fs")
    )
    rows = gathered.select(group, "chunk", "chunks", F.transform("fs", lambda x: x["f"]).alias("fs"))
    if groups is not None:
        clean = groups.select(group).distinct().join(gathered.select(group).distinct(), group, "left_anti")
        rows = rows.unionByName(clean.select(
            group, F.lit(0).cast("bigint").alias("chunk"), F.lit(1).cast("bigint").alias("chunks"),
            F.array().cast(rows.schema["fs"].dataType).alias("fs"),
        ))
    return rows.select(
        group, "chunk", "chunks", F.size("fs").cast("bigint").alias("findings"),
        build(F.col("fs")).alias("document"),
    )
