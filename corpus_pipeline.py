"""From raw documents to token counts: poor texts, repeated lines, near copies and test passages go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, decontaminate, jaccard, lines, quality
from auditlake.llm.queries import BYTE_BPE, ratings
from auditlake.llm.shared import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that more likely than not are of a good grade."""
    model = quality.train(docs, ratings(read_table(spark, sf_dir, "labels")), 3)
    return docs.filter(quality.rating(model, 1)["tail_probability"] >= 0.5)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents that had nothing else go."""
    clean = lines.without_repeats(docs.withColumn("_had", F.length(F.trim("text")) > 0))
    clean = clean.filter(~F.col("_had") | F.col("_had").isNull() | (F.length(F.trim("text")) > 0)).drop("_had")
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return docs.filter(F.size(decontaminate.leaks(read_table(spark, sf_dir, "benchmark"))) == 0)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, by document."""
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), BYTE_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding and decoding", tokenized),
]

# A fitted model, an edit join, a similarity join, tiling and a tokenizer: SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
