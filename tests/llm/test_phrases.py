"""Fill-in-middle texts and phrases of words that stand together."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from auditlake.llm import collocations, fim

# --- fill-in-middle -------------------------------------------------------------------


def brute_fim(key, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_moved_texts_equal_brute_force_and_come_back(docs, monkeypatch):
    monkeypatch.setattr(fim, "TOGETHER", 500)  # so that batches are put out in parts
    pick = random.Random(1)
    rows = [(i, "".join(pick.choice("aé漢😀<PSM> \n") for _ in range(pick.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "lone text"), (502, "a <M> b"), (503, "<<P<S"), (504, "é" * 300_000), rows[7], rows[7]]
    found = fim.round_trip(docs(rows).withColumnRenamed("lang", "form").withColumnRenamed("source", "restored"))
    assert found.columns == ["doc_id", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in found.collect()]
    assert sorted(got, key=str) == sorted((brute_fim(*row) for row in rows), key=str)
    assert Counter(bytes(r.restored).decode() for r in found.collect()) == Counter(t or "" for _, t in rows)
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}
    assert fim.round_trip(docs([])).count() == 0


def test_moved_texts_are_stored_and_restored_apart(docs):
    rows = [(i, f"text number {i} of the table") for i in range(60)]
    plan = fim.Plan(prefix="[pre]", suffix="[suf]", middle="[mid]", seed="other", moved=100, spm=50)
    moved = fim.fill_in_middle(docs(rows), plan=plan)
    assert moved.filter("form = 'plain'").count() == 0 and moved.select("form").distinct().count() == 2
    got = fim.restored(moved, plan=plan).selectExpr("doc_id", "decode(restored, 'UTF-8')").collect()
    assert sorted(map(tuple, got)) == rows


def test_blocks_change_places():
    for a in range(4):
        for b in range(4):
            held = bytearray(b"__" + b"abcd"[:a] + b"wxyz"[:b] + b"__")
            fim.rotate(held, 2, 2 + a, 2 + a + b)
            assert held == b"__" + b"wxyz"[:b] + b"abcd"[:a] + b"__"


# --- phrases --------------------------------------------------------------------------


def brute_phrases(rows, most, least, half):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {}
    often = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    for (lang, *words), a in often.items():
        longer = [b for (other, *w), b in often.items() if other == lang and len(w) > len(words) and words in (w[:2], w[1:])]
        if any(100 * b >= half * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, phrases in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:most], 1)
    )


def corpus(pick):
    words = [f"w{i}" for i in range(60)] + ["É", "Zoë", "ﬃ", "😀", "x y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = [["new", "york", "city"], ["red", "tape"], ["of", "the", "same", "kind"], ["Ab", "aB"]]
    rows = []
    for i in range(400):
        text = []
        for _ in range(pick.randint(0, 30)):
            text += pick.choice(fixed) if pick.random() < 0.15 else [pick.choices(words, weights)[0]]
            text.append(pick.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", " : "]) if pick.random() < 0.3 else " ")
        rows.append((" ".join(text), pick.choice(["en", "en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("most, sent", [(2000, 1 << 24), (15, 1 << 24), (15, 0)])
def test_phrases_equal_brute_force(spark, monkeypatch, most, sent):
    from auditlake.llm import shared

    monkeypatch.setattr(shared, "SENT_BYTES", sent)  # 0: every join is made by an exchange
    monkeypatch.setattr(collocations, "FRONTIER", 1)
    monkeypatch.setattr(collocations, "WIDER", 2)
    rounds = []
    monkeypatch.setattr(collocations, "_limits", lambda counts, rank, real=collocations._limits: rounds.append(rank) or real(counts, rank))
    rows = [*corpus(random.Random(3)), (None, "en"), ("", None), (" \t,.", "fr"), ("long " * 30_000, "es")]
    frame = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "1 AS a", "2 AS rank", "'p' AS phrase")
    found = collocations.mine(frame, most=most)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, most, 10, 50)
    assert (len(rounds) > 1) == (most == 15)


def test_scores_are_exact(spark):
    a, left, right = 3 * 10**17 + 1, 9 * 10**17, 8 * 10**17 + 7
    frame = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert frame.select(collocations.share("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)


def test_phrases_of_nothing(docs):
    assert collocations.mine(docs([])).count() == 0
    assert collocations.mine(docs([(1, "a b"), (2, None)])).count() == 0
