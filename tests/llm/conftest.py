from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A function that makes documents of ``(doc_id, text)`` rows, with a column of another kind."""

    def make(rows):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        return frame.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars")

    return make


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
