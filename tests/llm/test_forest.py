"""Approximate search in a forest of hash prefixes, held against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from auditlake.llm import forest, queries
from pyspark.sql import functions as F


def brute(rows, asked, k):
    """Best ids and scores of each query, every pair compared."""
    found = {}
    for q in asked:
        best: dict[int, float] = {}
        for key, own in rows:
            if key != q:
                continue
            for other, v in rows:
                if other != q:
                    score = float((v * own).sum() / (np.sqrt((v * v).sum()) * np.sqrt((own * own).sum())))
                    best[other] = max(score, best.get(other, -2.0))
        found[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return found


def small(monkeypatch):
    for name, value in (("SHARD_ROWS", 100), ("TOGETHER", 2), ("CHUNK", (3, 50))):
        monkeypatch.setattr(forest, name, value)


def answers(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_and_scores(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(5)
    # Even noise is the hardest case; some vectors lie close together.
    array = rng.normal(size=(1500, 32))
    array[1000:] = array[rng.integers(0, 50, 500)] + 0.2 * rng.normal(size=(500, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(array)], "vec_id bigint, vector array<double>")
    held = forest.index(frame, 5)
    assert held.count > 4 and held.shards.count() == held.count
    got = answers(forest.search(held, frame.filter("vec_id % 10 = 0"), 5))
    expected = brute(list(enumerate(array)), range(0, 1500, 10), 5)
    assert set(got) == set(expected) and all(len(x) == 5 for x in got.values())
    right = sum(len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) for q in expected)
    assert right >= 0.9 * 5 * len(expected)
    for q, found in got.items():
        for other, score in found:
            exact = array[q] @ array[other] / (np.linalg.norm(array[q]) * np.linalg.norm(array[other]))
            assert abs(score - exact) < 1e-12
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    # A bound that misses nothing makes the search exact.
    assert {q: [a for a, _ in x] for q, x in answers(forest.search(held, frame.filter("vec_id % 100 = 0"), 5, miss=0.0)).items()} == {
        q: [a for a, _ in expected[q]] for q in range(0, 1500, 100)
    }


def test_copies_ties_and_odd_vectors(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, -3.0]) for i in range(0, 400)]  # a group of equal vectors
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(1100, [3.0]), (1150, [6.0, 0.0]), (50, [-1.0, 0.5, 0.5]), (50, [1.0, 2.0, -3.0]), (1200, [1e200, 2e200, -3e200]), (1250, [1e-200, 0.0, 0.0])]
    odd = [(2000, None), (2050, []), (2100, [0.0, 0.0]), (2150, [1.0, None]), (2200, [float("nan")]), (2250, [float("-inf")]), (None, [1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, vector array<double>").selectExpr("vec_id", "vector", "1 AS rank", "'s' AS score", "2 AS shard")
    got = answers(forest.search(forest.index(frame, 5), frame.filter("vec_id % 50 = 0"), 5))
    known = [(i, np.array([*v, 0.0, 0.0, 0.0][:3]) / max(1.0, max(map(abs, v)) / 10)) for i, v in rows if i != 1250] + [(1250, np.array([1.0, 0, 0]))]
    expected = brute(known, [i for i in {i for i, _ in rows} if i % 50 == 0], 5)
    assert set(got) == set(expected)
    for q, found in got.items():
        assert np.allclose([s for _, s in found], [s for _, s in expected[q]], atol=1e-12)
    assert [a for a, _ in got[0]] == [1, 2, 3, 4, 5] and [a for a, _ in got[100]] == [0, 1, 2, 3, 4]


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id bigint, vector array<float>")
    held = forest.index(frame, 5)
    assert [tuple(r) for r in forest.search(held, frame.filter("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]
    assert forest.search(held, frame.limit(0), 5).count() == 0
    assert forest.search(forest.index(frame.limit(0), 5), frame, 5).count() == 0
    with pytest.raises(ValueError):
        forest.search(held, frame, 6)


def test_prefixes():
    a, b = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64), np.array([0, 0, 0, (1 << 64) - 2], np.uint64)
    assert forest.shared_bits(a, b).tolist() == [64, 63, 0, 63]
    assert forest.enough(1.0, 0.08) == 64 and forest.enough(-np.inf, 0.08) == 0
    assert 0 < forest.enough(0.4, 0.08) < forest.enough(0.9, 0.08)


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()]
    got = answers(queries.op12_forest(spark, sf))
    expected = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert set(got) == set(expected)
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) for q in expected) >= 0.9 * 5 * len(expected)
