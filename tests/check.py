"""Compare queries with their SQL: ``python tests/check.py [sf_dir] [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of_spark(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    rows = frame.select(*names).collect()
    return names, sorted((tuple(r) for r in rows), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    where = [columns.index(n) for n in names]
    rows = [tuple(r[i] for i in where) for r in found.fetchall()]
    return names, sorted(rows, key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """``None`` if both sides agree, else what differs."""
    left = rows_of_spark(entry.queries()[name](spark, sf_dir))
    right = rows_of_sql(con, entry.oracle_sql()[name])
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    only = [r for r in left[1] if r not in set(right[1])][:2]
    other = [r for r in right[1] if r not in set(left[1])][:2]
    return f"{len(left[1])} rows != {len(right[1])}; only here {only}; only there {other}"


if __name__ == "__main__":
    from conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        begin = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    sys.exit(bad > 0)
