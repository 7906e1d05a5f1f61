"""Top-k search, WARC archives, toxicity, quality, decontamination, and the pipeline."""

from __future__ import annotations

import random

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
import pytest
from auditlake.llm import decontaminate, queries, quality, topk, toxicity, warc
from check import compare, connect
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_with_sql(spark, name):
    assert compare(spark, connect(SF), SF, name) is None


def test_every_query_is_registered():
    names = set(queries.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert names <= set(entry.queries())


# --- search ---------------------------------------------------------------------------


def test_search_equals_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 50), ("GROUP", 120), ("QUERIES", 7)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    array = np.floor(64 * rng.normal(0, 0.3, (400, 40)))
    array[50:90] = array[7]
    rows = [(i, array[i].tolist()) for i in range(400)]
    rows += [(500, None), (520, []), (540, [1.0, None]), (560, [1.0, float("nan")]), (580, [float("inf")]), (None, [1.0]), (600, [3.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").withColumn("rank", F.lit("x"))
    found = topk.search(frame, F.col("vec_id") % 20 == 0, 20)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    usable = {**{i: array[i] for i in range(400)}, 520: np.zeros(40), 600: np.array([3.0, 4.0] + [0] * 38)}
    expected = []
    for q in (i for i in usable if i % 20 == 0):
        best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:20]
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_search_of_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, vector array<double>")
    assert topk.search(frame, F.col("vec_id") == 0, 20).collect() == [(0, 1, 1, 2)]
    assert topk.search(frame.limit(0), F.col("vec_id") == 0, 20).count() == 0


def test_search_of_large_values_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(int(x)) for x in rng.integers(-9, 9, 5) * 10 ** int(rng.choice([0, 0, 8]))]) for i in range(60)]
    rows += [(100, [2.0**62, 1.0, 0.0, 0.0, 0.0]), (101, [-(2.0**62), 3.0, 0.0, 0.0, 0.0]), (102, [2.0**53 + 2, 1.0, 0.0, 0.0, 0.0])]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (20, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    found = topk.search(frame, F.col("vec_id") % 20 == 0, 20)
    expected = []
    for q in {i for i, _ in rows if i % 20 == 0}:
        scored = []
        for own in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    exact = sum(int(a) * int(b) for a, b in zip(own, v, strict=False))
                    scored.append((-max(-(2**63) + 1, min(2**63 - 1, exact)), i))
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:20], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


# --- archives -------------------------------------------------------------------------


def test_archives_round_trip(spark, monkeypatch):
    big, other = "é<p>" * 30_000, "x" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (3, None, other), (9, "u9", other), (4, "u4", other[:999]), (5, "u5", other[:999]), (6, "u6", None), (None, "u7", ""), (2, "u2", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("type", F.lit(1))
    archives = warc.write(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.error) for r in warc.read_pages(archives).collect()), key=str)
    size = len(big.encode())
    assert got == sorted([
        (1, size, "revisit", 2, None), (2, size, "response", None, None), (2, size, "response", None, None),
        (3, 1000, "revisit", 9, None), (9, 1000, "response", None, None), (4, 999, "response", None, None),
        (5, 999, "response", None, None), (6, 0, "response", None, None), (None, 0, "response", None, None),
    ], key=str)
    records = warc.read_records(archives)
    assert records.filter("type = 'continuation'").count() == 2 * ((size + 100) // warc.SEGMENT)
    whole = {r.page_id: bytes(r.payload) for r in warc.reassemble(records).filter("type = 'response'").collect()}
    assert whole[2] == big.encode() and whole[9] == other.encode()
    broken = warc.reassemble(records.filter("number IS NULL OR number <> 2")).filter("error IS NOT NULL")
    assert {r.error for r in broken.collect()} == {"segment missing"}
    assert warc.read_pages(warc.write(pages.limit(0))).count() == 0


def test_chunks():
    for size in (0, 1, warc.CHUNK, warc.CHUNK + 1):
        assert warc.unchunked(warc.chunked(b"a" * size)) == b"a" * size
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


# --- toxicity -------------------------------------------------------------------------


def kinds(text, insults=("fool",)):
    symbols = []
    for word in text.split():
        listed = ((insults, "I"), (toxicity.THREATS, "T"), (toxicity.TARGETS, "Y"), (toxicity.NEGATIONS, "N"), (toxicity.REPORTS, "R"))
        symbols.append(next((s for ws, s in listed if word in ws), "o"))
    return [k for k, _ in toxicity.match_clause(symbols, [1.0] * len(symbols))]


@pytest.mark.parametrize("text, expected", [
    ("what a fool", ["I"]), ("you are a fool", ["A"]), ("not a fool", ["i"]), ("not one of the many a fool", ["I"]),
    ("he said fool", ["q"]), ("kill them", ["X"]), ("kill time", []), ("the report says kill them", ["q"]), ("fool and fool", ["I", "I"]),
])
def test_grammar(text, expected):
    assert kinds(text) == expected


def test_toxicity_learns_and_generalizes(spark, docs):
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("aeioumnrst") for _ in range(7))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[pick.randrange(30)] = pick.choice(["blergh", "grumpfel", "grumpfix"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (10_000, 1)]
    rated = spark.createDataFrame(labels[::2], "doc_id bigint, toxic int").withColumn("text", F.lit("x"))
    grammar = toxicity.learn(docs(rows), rated)
    test = docs([*rows, (500, None), (501, ""), (502, "ok " * 50_000)]).withColumnRenamed("lang", "score")
    found = {r.doc_id: r.score for r in toxicity.score(test, grammar).collect()}
    right = [(found[i] >= 0.7) == bool(t) for i, t in labels[1:400:2]]
    assert sum(right) >= 0.95 * len(right)
    assert found[500] == found[501] == found[502] < 0.3


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    grammar = toxicity.learn(docs([(1, "a")]), none)
    assert [r.score for r in toxicity.score(docs([(1, "a"), (2, None)]), grammar).collect()] == [0.5, 0.5]
    assert toxicity.score(docs([]), grammar).count() == 0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = queries.op4_toxicity(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id")
    rows = [(r.predicted, r.toxic) for r in scored.collect()]
    assert sum(p == t for p, t in rows) >= 0.93 * len(rows)


# --- quality --------------------------------------------------------------------------


def test_thresholds_are_ordered_and_grades_found():
    pick = np.random.default_rng(0)
    grades = np.repeat([0, 1, 2, 3], 60)
    texts = [" ".join(pick.choice([f"g{g}", f"g{max(0, g - 1)}", "x", "y"], 30)) for g in grades]
    model = quality.fit(*quality.features(texts), grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    expected = model.reaching(model.scores(texts)).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    even = labels.filter("doc_id % 2 = 0")
    model = quality.train(docs, queries.ratings(even), 3)
    rated = quality.rate(docs, model, 1).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rows = [(r.tail_probability >= 0.5, r.quality == 1) for r in rated.collect()]
    assert sum(a == b for a, b in rows) >= 0.95 * len(rows)


def test_quality_of_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    model = quality.train(docs([(1, "a")]), none, 3)
    frame = docs([(1, None), (None, ""), (2, "a"), (2, "a"), (3, "b " * 100_000)]).withColumnRenamed("lang", "expected_grade")
    got = quality.rate(frame, model, 1)
    assert got.filter("tail_probability >= 0.5").count() == 5
    assert quality.rate(docs([]), model, 1).count() == 0
    one = spark.createDataFrame([(1, 2), (2, None), (None, 1)], "doc_id bigint, grade int")
    assert quality.rate(docs([(1, "a")]), quality.train(docs([(1, "a"), (2, "b")]), one, 3), 1).count() == 1


# --- decontamination ------------------------------------------------------------------


def brute_tiles(p, t, least):
    free_p, free_t, covered = [True] * len(p), [True] * len(t), 0
    while True:
        best, found = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n >= max(least, best):
                    found, best = ([] if n > best else found) + [(i, j)], n
        if not found:
            return covered
        for i, j in found:
            if all(free_p[i : i + best]) and all(free_t[j : j + best]):
                free_p[i : i + best] = free_t[j : j + best] = [False] * best
                covered += best


def test_tiles_cover_as_brute_force():
    pick = random.Random(0)
    for _ in range(600):
        p = [pick.randint(0, 3) for _ in range(pick.randint(0, 25))]
        t = [pick.randint(0, 3) for _ in range(pick.randint(0, 30))]
        if len(p) > 6 and pick.random() < 0.5:
            k = pick.randint(1, len(p) - 1)
            t = t[:5] + p[k:] + t[5:9] + p[:k]
        assert sum(n for *_, n in decontaminate.tile(p, t, 3)) == brute_tiles(p, t, 3)


def test_leaks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 40)  # so that passages come in several blocks
    passage = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(5)]
    items = spark.createDataFrame([*enumerate(passage), (7, "too short"), (8, None), (None, passage[0]), (9, passage[0])], "item_id bigint, text string")
    w = passage[1].split()
    rows = [
        (0, f"Before {passage[0].upper()}! after"), (1, " ".join(w[10:] + ["and"] + w[:10])), (2, " ".join(w[:12])),
        (3, " ".join(w[:17])), (4, None), (5, ""), (6, "word " * 50_000 + passage[2]), (6, passage[2]), (None, "too short"),
    ]
    found = decontaminate.with_leaks(docs(rows).withColumnRenamed("lang", "leaks"), items)
    got = sorted((r.doc_id if r.doc_id is not None else -1, x.item_id, round(x.coverage, 2), x.tiles) for r in found.collect() for x in r.leaks)
    assert got == [(0, 0, 1.0, 1), (0, 9, 1.0, 1), (1, 1, 1.0, 2), (3, 1, 0.85, 1), (6, 2, 1.0, 1), (6, 2, 1.0, 1)]
    assert decontaminate.with_leaks(docs(rows), items.limit(0)).filter("size(leaks) > 0").count() == 0
    assert decontaminate.with_leaks(docs([]), items).count() == 0


# --- pipeline -------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs([(10**6, None), (10**6 + 1, ""), (None, "Lone text of a few words here.")]).select(given.columns)
    now = given.unionByName(extra).withColumns({"leaks": F.lit(1), "n_lines": F.lit(2), "expected_grade": F.lit("g"), "key": F.lit(3)})
    before = now.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == now.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert 0 < now.count() <= before
        before = now.count()
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_run_equals_its_stages_and_takes_nothing(spark, tmp_path):
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == whole.select("doc_id").distinct().count() > 0
    for name in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{SF}/{name}.parquet")
        (frame.limit(0) if name == "documents" else frame).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
