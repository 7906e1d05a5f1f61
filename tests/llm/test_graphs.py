"""Shards, near copies, repeated lines and components."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from auditlake.llm import jaccard, lines, sharding
from auditlake.llm.graph import components
from pyspark.sql import functions as F


def tops(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 101), (None, 3)],
])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    whole = [(a, b) for a, b in links if a is not None]
    assert dict(map(tuple, components(frame).collect())) == tops({n for link in whole for n in link}, whole)


# --- shards ---------------------------------------------------------------------------


def sharded(frame, shards=8):
    return sharding.shard_documents(frame, shards).collect()


def test_shards_are_even_and_groups_stay_together(docs):
    pick = random.Random(1)
    rows = [(i, "x" * pick.randint(1, 3000)) for i in range(600)] + [(1000 + i, f"copy {i % 20} " * 30) for i in range(200)]
    found = sharded(docs(rows))
    sizes, slots, texts = Counter(), defaultdict(list), dict(rows)
    where = defaultdict(set)
    for r in found:
        assert r["size"] == len(texts[r.doc_id]) + 1
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id]].add(r.shard)
    assert max(sizes.values()) <= 1.01 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = [s for t, s in where.items() if t.startswith("copy")]
    assert sum(len(s) > 1 for s in groups) <= 2


def test_one_group_of_a_third_of_all_rows(docs):
    rows = [(i, "same text " * 20) for i in range(1200)] + [(5000 + i, f"other {i} " * 25) for i in range(2000)]
    sizes = Counter()
    for r in sharded(docs(rows)):
        sizes[r.shard] += r["size"]
    assert sum(sizes.values()) == sum(len(t) + 1 for _, t in rows)
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


def test_groups_of_any_size_stay_in_one_shard_while_room_lasts(docs):
    groups = (300, 300, 400, 512, 513, 700, 1000, 1025, 2000, 5000)
    rows = [(10_000 * g + i, f"copy {g} " * 5) for g, n in enumerate(groups) for i in range(n)]
    rows += [(10**6 + i, f"pair {i % 300:03d} " * 5) for i in range(900)] + [(10**7 + i, f"other {i:05d} " * 4) for i in range(30_000)]
    texts, where, sizes = dict(rows), defaultdict(set), Counter()
    for r in sharded(docs(rows)):
        where[texts[r.doc_id]].add(r.shard)
        sizes[r.shard] += r["size"]
    assert [len(s) for t, s in where.items() if t.startswith("copy")] == [1] * len(groups)
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("pair")) <= 3
    assert max(sizes.values()) <= 1.01 * min(sizes.values())


def test_groups_larger_than_a_shard_fill_few(docs, monkeypatch):
    rows = [(i, "same text " * 20) for i in range(1200)] + [(5000 + i, f"other {i} " * 25) for i in range(2000)]
    texts = dict(rows)
    assert len({r.shard for r in sharded(docs(rows)) if texts[r.doc_id].startswith("same")}) <= 4
    monkeypatch.setattr(sharding, "HEAVY", 0)  # so that all groups are laid in a line
    rows += [(10_000 + 1000 * g + i, f"copy {g} " * 5) for g in range(4) for i in range(300)]
    texts = dict(rows)
    found = sharded(docs(rows))
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


def test_shards_of_nulls_repeats_and_nothing(docs):
    rows = [(1, None), (None, None), (None, "é"), (2, ""), (2, ""), (2, "")]
    found = sharded(docs(rows))
    assert sorted((r["size"], r.text_crc32) for r in found) == [(1, 0)] * 5 + [(3, zlib.crc32("é".encode()))]
    assert Counter(r["size"] for r in found) == {1: 5, 3: 1} and len(found) == 6
    assert sharded(docs([])) == []


def test_quotas_keep_room():
    quotas = sharding._quotas({(0, 1): 50, (1, 0): 20, (2, 1): 40}, [100, 90, 100], [100, 100, 100])
    assert quotas[0, 1] >= 20 and quotas[1, 0] == 20
    assert quotas[0, 1] + quotas[2, 1] - quotas[1, 0] <= 10


# --- near copies ----------------------------------------------------------------------


def brute_classes(rows, width=5, similarity=0.8):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\W\d_]+|\d+", (text or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links, degree = [], Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            equal = (rows[i][1] or "") == (rows[j][1] or "")
            if equal or (sets[i] and sets[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
    top = tops(range(len(rows)), links)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[top[i]].append(key)
    return sorted(((rows[i][0], min((k for k in least[top[i]] if k is not None), default=None), degree[i]) for i in range(len(rows))), key=str)


def family(pick, size, words=80, changes=2):
    base = [f"w{pick.randint(0, 999)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(pick.randint(0, changes)):
            own[pick.randrange(words)] = f"v{pick.randint(0, 99)}"
        yield " ".join(own)


def test_near_copies_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)  # so that families have several blocks
    pick = random.Random(7)
    texts = [t for n in (2, 3, 5, 90) for t in family(pick, n)]
    texts += ["a b c", "A, b c!", "a b", None, "", "", "!!", "!!", texts[-1], texts[-1], "one two three four five six " * 400]
    rows = [(i * 3 % 101 + 200 * (i // 101), t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone in the world of texts")]
    found = jaccard.near_duplicates(docs(rows).withColumnRenamed("lang", "class_id"))
    assert sorted(map(tuple, found.collect()), key=str) == brute_classes(rows)


def test_blocks_are_bounded_by_members_too(spark):
    nodes = spark.range(9001).selectExpr("if(id < 9000, 1, 2) AS family", "if(id < 9000, 1, 450000) AS n")
    assert dict(map(tuple, jaccard._blocks(nodes).collect())) == {1: 5, 2: 5}


def test_one_of_each(docs):
    pick = random.Random(8)
    rows = [(9 - i, t) for i, t in enumerate(family(pick, 4))] + [(20, "x"), (20, "x"), (None, "x y z"), (None, "x y z"), (None, None), (3, "")]
    kept = jaccard.one_of_each(docs(rows).withColumnRenamed("source", "key"))
    assert kept.columns == ["doc_id", "text", "lang", "key", "n_chars"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(6, rows[3][1]), (20, "x"), (None, "x y z"), (3, "")], key=str)


def test_near_copies_of_nothing(docs):
    assert jaccard.near_duplicates(docs([])).count() == 0 and jaccard.one_of_each(docs([])).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    least = jaccard.least_matches(0.8)
    assert least[16] < least[96] < 0.8 * 96
    same = np.arange(jaccard.VALUES, dtype=np.uint32)[None, :]
    assert jaccard.surviving(same, same, 0.8).tolist() == [0] and jaccard.surviving(same, same + 1000, 0.8).tolist() == []


# --- lines ----------------------------------------------------------------------------


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def edited(pick, text, edits):
    for _ in range(edits):
        i, kind = pick.randint(0, len(text)), pick.randint(0, 2)
        text = text[:i] + pick.choice("abcé") * (kind != 1) + text[i + (kind != 0) :]
    return text


def test_banded_distance():
    pick = random.Random(3)
    for _ in range(4000):
        a = "".join(pick.choice("abc") for _ in range(pick.randint(0, 14)))
        b = edited(pick, a, pick.randint(0, 4))
        for edits in range(4):
            assert lines.within(a, b, edits) == (distance(a, b) <= edits)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_segments_meet_for_every_near_pair(edits):
    pick = random.Random(edits)
    for _ in range(300):
        a = "".join(pick.choice("ab") for _ in range(pick.randint(12, 40)))
        b = edited(pick, a, edits)
        if distance(a, b) > edits:
            continue
        keys, owners, roles = lines.segment_keys([a, b], edits)
        sides = [{(o, k) for k, o, r in zip(keys, owners, roles, strict=True) if r == role} for role in (0, 1)]
        # Rows of the index probe as well.
        assert any((1 - o, k) in sides[1] for o, k in sides[0] | sides[1])


def brute_lines(rows, edits=2, least=20):
    every = sorted({x for _, t in rows if t is not None for x in t.split("\n") if x.strip()})
    number = {x: i for i, x in enumerate(every)}
    long = [i for i, x in enumerate(every) if len(x) >= least]
    top = tops(range(len(every)), [(i, j) for i in long for j in long if j < i and abs(len(every[i]) - len(every[j])) <= edits and distance(every[i], every[j]) <= edits])
    seen, found = set(), []
    for key, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            found.append((key, 0, 0, None))
            continue
        kept = []
        for x in text.split("\n"):
            if not x.strip() or top[number[x]] not in seen:
                kept.append(x)
            if x.strip():
                seen.add(top[number[x]])
        found.append((key, text.count("\n") + 1, text.count("\n") + 1 - len(kept), "\n".join(kept)))
    return found


def test_lines_equal_brute_force(docs):
    pick = random.Random(4)
    bases = ["".join(pick.choice("abcdefgh ") for _ in range(pick.randint(19, 60))) for _ in range(25)]
    rows = []
    for i in range(60):
        some = [edited(pick, pick.choice(bases), pick.choice((0, 0, 0, 1, 2))) for _ in range(pick.randint(0, 6))]
        rows.append((i, "\n".join([*some, "short", "short", f"s{i % 50}", " ", f"own line number {i} " + "z" * i * 3])))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, rows[3][1])]
    found = lines.dedup_lines(docs(rows).withColumnRenamed("lang", "n_lines").withColumnRenamed("source", "dropped"))
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == brute_lines(rows)


def test_very_long_lines(docs):
    # One edit, two edits and three edits away from the first; known without a table of distances.
    rows = [(1, "q" * 30_000), (2, "q" * 29_999 + "r"), (3, "q" * 15_000 + "rs" + "q" * 15_000), (4, "x" + "q" * 10_000 + "y" + "q" * 19_999 + "z"), (5, "p" * 30_000)]
    found = lines.dedup_lines(docs(rows)).select("doc_id", "n_dropped", "text").collect()
    assert sorted((r.doc_id, r.n_dropped, len(r.text)) for r in found) == [(1, 0, 30_000), (2, 1, 0), (3, 1, 0), (4, 0, 30_002), (5, 0, 30_000)]


def test_documents_that_change_partitions_are_an_error(docs):
    rows = [(i, f"a line that stands in every text\nown line number {i}") for i in range(200)]
    given = docs(rows)
    moved = lines.repeated_lines(given).withColumn("part", F.pmod(F.col("part") + 1, F.lit(given.rdd.getNumPartitions())))
    with pytest.raises(Exception, match="other partitions"):
        lines._rebuilt(given, moved, "doc_id", "text")[0].collect()


def test_lines_of_repeated_rows_and_nothing(docs):
    row = (1, "a line that is long enough\nanother line that is long enough")
    kept = lines.without_repeats(docs([row, row, (1, "a line that is long enough"), (None, "a line that is long enough?")]))
    got = sorted((r.doc_id is None, r.text) for r in kept.collect())
    # The null id comes first and keeps its line; rows of one id and text are treated alike.
    assert len(got) == 4 and got[-1] == (True, "a line that is long enough?")
    assert [t for none, t in got if not none].count("another line that is long enough") == 2
    assert lines.dedup_lines(docs([])).count() == 0


def test_hot_keys_are_dealt_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(lines, "RUN", 4)
    dealt = []
    monkeypatch.setattr(lines, "_dealt", lambda hot, run, real=lines._dealt: dealt.append(real(hot, run)) or dealt[-1])
    pick = random.Random(5)
    rows = [(i, f"a common head {pick.randint(0, 999):03d} a common tail{'z' * (i % 3)}") for i in range(60)]
    rows += [(200 + i, f"own line {i} " + "y" * i) for i in range(12, 24)]
    found = lines.dedup_lines(docs(rows)).select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted(map(tuple, found.collect())) == brute_lines(rows)
    (cells,) = dealt
    sizes = [r["count"] for r in cells.groupBy("key", (cells["tag"] % 2 != 0).alias("index")).count().collect()]
    assert len(sizes) > 50 and max(sizes) <= 20


def test_texts_are_not_exchanged(docs):
    rows = [(i, "\n".join(f"{c} a line that stands in both texts" + c * n for c in "abcdef" for n in range(3, 30, 3))) for i in range(2)]
    found = lines.dedup_lines(docs(rows))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.select("doc_id", "n_lines", "n_dropped", "text").collect()))
    assert got == brute_lines(rows)


def test_parities_differ_by_no_more_than_edits_allow():
    pick = random.Random(6)
    for _ in range(3000):
        a, edits = "".join(pick.choice("abcdé fg") for _ in range(pick.randint(20, 60))), pick.randint(0, 3)
        one, two = lines.parities([a, edited(pick, a, edits)])
        assert np.bitwise_count(one[0] ^ one[1]) <= 2 * edits
        assert np.bitwise_count((two[:1] ^ two[1:]).view(np.uint64))[0] <= 4 * edits
