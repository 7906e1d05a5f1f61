"""Every registered query against its SQL, on the smallest data set."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from auditlake.plans.oracle import ORACLE
from auditlake.plans.queries import QUERIES
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
