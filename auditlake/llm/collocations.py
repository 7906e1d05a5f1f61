"""Phrases of two and three words that stand together more often than their parts suggest, by language.

Texts are cut at punctuation and line ends into pieces and at blanks and tabs into words; A to Z count
as a to z. A phrase's score is a million times the square of its count over the product of the counts
of its two parts, rounded down, at the cut where this is lowest. A phrase inside a longer candidate that
stands at least half as often is dropped.

Growth is best first, with bounds. Pairs are counted together with the last word of each piece, which
gives the counts of words as well. A pair is the prefix of longer phrases: cut after its first word, no
growth of it can score above its own count over that of its first word; and, as the end of a phrase, not
above its count over that of its last word. Pairs are settled in the order of scores: a language's limit
starts at the score of its pair of rank ``FRONTIER`` times the length of the list. Pairs at or above the
limit, and prefixes and endings whose bound is, are expanded, that is their growths are counted. All
phrases at or above the limit are then known, with all that can drop them. A language with a full list
of survivors is settled, ties included; for the others the limit goes down, in the end to nothing.

Null texts count as empty, a null language as ``und``. Rows without words add nothing; repeated rows
count each. A language without candidates has no rows, nor has an empty table. Texts of any length are
taken whole. Other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.shared import bounded, stored

# Where pieces end, what stands between words, the language of rows that name none.
PIECES, BLANKS, UNKNOWN = ".,;:!?\x0a\x0b\x0c\x0d", "\x20\x09", "und"
# The limit starts at the score of the pair of this rank, in lists, and goes down by as many ranks each time.
FRONTIER, WIDER = 2, 8
# Scores are parts of so many.
WHOLE = 1_000_000


# Every end of a piece as a line feed, every blank as a space, A to Z as a to z; other bytes of UTF-8 stay.
_PLAIN = bytes.maketrans(
    (PIECES + BLANKS + string.ascii_uppercase).encode(), ("\n" * len(PIECES) + " " * len(BLANKS) + string.ascii_lowercase).encode()
)


@F.arrow_udf(T.StringType())
def plain(text: pa.Array) -> pa.Array:
    """Texts with one sign for every end of a piece and one for every blank, byte for byte."""
    text = text.cast(pa.string())
    valid, offsets, data = text.buffers()
    changed = pa.py_buffer((data.to_pybytes() if data else b"").translate(_PLAIN))
    return pa.Array.from_buffers(pa.string(), len(text), [valid, offsets, changed], text.null_count, text.offset)


def _pieces(documents: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, words)``: the words of every piece that has any."""
    pieces = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(plain(text), "\n")).alias("piece")
    )
    return pieces.select("lang", F.array_remove(F.split("piece", " "), "").alias("words")).filter(F.size("words") > 0)


def _runs(pieces: DataFrame, words: int) -> DataFrame:
    """Every run of ``words`` words; those that reach beyond the end of a piece have nulls there."""
    shifted = [F.col("words"), *(F.slice("words", i + 1, F.size("words")) for i in range(1, words))]
    zipped = F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(shifted, 1)))
    return pieces.select("lang", F.inline(zipped)).toDF("lang", *(f"w{i}" for i in range(1, words + 1)))


def _counted(runs: DataFrame, words: int) -> DataFrame:
    """How often each run stands in its language. Words hold no space, so that one string is key enough."""
    names = [f"w{i}" for i in range(1, words + 1)]
    key = F.concat_ws(" ", *(F.coalesce(w, F.lit("")) for w in names), "lang")
    counted = runs.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("a"))
    parts = counted.select(F.split("key", " ", words + 1).alias("parts"), "a")
    return parts.select(F.col("parts")[words].alias("lang"), *(F.nullif(F.col("parts")[i], F.lit("")).alias(w) for i, w in enumerate(names)), "a")


@F.pandas_udf(T.LongType())
def share(a: pd.Series, l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
    """``a`` squared over ``l`` times ``r`` in millionths, rounded down, in integers of any size."""
    big = [np.array(x.tolist(), object) for x in (a, l, r)]
    return pd.Series((WHOLE * big[0] * big[0] // (big[1] * big[2])).astype("int64") if len(a) else [], dtype="int64")


def _bound(a: Column, of: Column) -> Column:
    """``a`` over ``of`` in millionths, rounded up a little."""
    return F.ceil(WHOLE * (a.cast("double") / of) * (1 + 1e-9))


class Counts:
    """What pairs alone tell: counts of words, and every pair that stands often enough."""

    def __init__(self, pieces: DataFrame, least: int) -> None:
        pairs = stored(_counted(_runs(pieces, 2), 2), "pairs")
        self.totals = stored(pairs.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
        words = pairs.groupBy("lang", "w1").agg(F.sum("a").alias("f")).filter(F.col("f") >= least)
        self.words = stored(words.withColumnRenamed("w1", "w"), "words")
        often = pairs.filter(F.col("w2").isNotNull() & (F.col("a") >= least))
        known = bounded(self.words, "lang", "w")
        first = known.select("lang", F.col("w").alias("w1"), F.col("f").alias("f1"))
        last = known.select("lang", F.col("w").alias("w2"), F.col("f").alias("f2"))
        scored = often.join(first, ["lang", "w1"]).join(last, ["lang", "w2"])
        a, f1, f2 = F.col("a"), F.col("f1"), F.col("f2")
        self.pairs = stored(
            scored.select("lang", "w1", "w2", "a", "f1", "f2", share(a, f1, f2).alias("score"), _bound(a, f1).alias("grown"), _bound(a, f2).alias("ending")),
            "scored-pairs",
        )


def _limits(counts: Counts, rank: int) -> DataFrame:
    """``(lang, limit)``: the score of each language's pair of a rank, 0 where it has fewer."""
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    first = counts.pairs.select("lang", "score").withColumn("rank", best).filter(F.col("rank") <= rank)
    limit = F.when(F.count("*") == rank, F.min("score")).otherwise(0)
    return first.groupBy("lang").agg(limit.alias("limit"))


def _triples(pieces: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Counts of the runs of three words that open nodes grow into, or end."""
    grown = nodes.filter(F.col("grown") >= F.col("limit")).select("lang", "w1", "w2", F.lit(True).alias("_grown"))
    ending = nodes.filter(F.col("ending") >= F.col("limit")).select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.lit(True).alias("_ending"))
    runs = _runs(pieces, 3).filter("w3 IS NOT NULL")
    grown, sent = bounded(stored(grown, "grown"), "lang", "w1", "w2", told=True)
    ending, sent_too = bounded(stored(ending, "endings"), "lang", "w2", "w3", told=True)
    counted = lambda rows: _counted(rows, 3).filter(F.col("a") >= least)
    open_ = lambda rows: rows.join(grown, ["lang", "w1", "w2"], "left").join(ending, ["lang", "w2", "w3"], "left").filter("_grown OR _ending")
    # Sent nodes thin the runs out before they are exchanged; a join by exchange comes after the counts.
    return counted(open_(runs)) if sent and sent_too else open_(counted(runs)).select("lang", "w1", "w2", "w3", "a")


def _settled(pieces: DataFrame, counts: Counts, limits: DataFrame, least: int, half: int) -> DataFrame:
    """All surviving phrases at or above their language's limit."""
    limits = bounded(limits, "lang")
    nodes = counts.pairs.join(limits, "lang")
    triples = stored(_triples(pieces, nodes, least), "triples")
    known = bounded(counts.pairs, "lang", "w1", "w2")
    front = known.select("lang", "w1", "w2", F.col("a").alias("l2"), F.col("f1").alias("l1"))
    back = known.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("f2").alias("r2"))
    both = triples.join(front, ["lang", "w1", "w2"]).join(back, ["lang", "w2", "w3"])
    both = both.withColumns({"s1": share(F.col("a"), F.col("l1"), F.col("r1")), "s2": share(F.col("a"), F.col("l2"), F.col("r2"))})
    early = F.col("s1") <= F.col("s2")
    pick = lambda one, two: F.when(early, F.col(one)).otherwise(F.col(two))
    three = stored(
        both.select("lang", "w1", "w2", "w3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score")),
        "scored-triples",
    )
    inside = three.select("lang", F.col("w1"), F.col("w2"), "a").union(three.select("lang", "w2", "w3", "a"))
    most = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    at = F.col("score") >= F.col("limit")
    pairs = nodes.filter(at).join(most, ["lang", "w1", "w2"], "left")
    # In exact integers, as twice a count stays far below 64 bits for any corpus.
    pairs = pairs.filter(F.col("longer").isNull() | (100 * F.col("longer") < half * F.col("a")))
    long = three.join(limits, "lang").filter(at)
    return stored(
        pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score", "limit")
        .unionByName(long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score", "limit")),
        "survivors",
    )


def mine(documents: DataFrame, lang: str = "lang", text: str = "text", most: int = 2000, least: int = 10, half: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``most`` phrases of each language.

    Candidates stand at least ``least`` times; one inside a longer candidate is dropped if that stands
    at least ``half`` percent as often.
    """
    pieces = _pieces(documents, lang, text)
    counts = Counts(pieces, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rank, left, found = FRONTIER * most, None, None
    while True:
        limits = _limits(counts, rank)
        limits = stored(limits if left is None else limits.join(left, "lang", "left_semi"), "limits")
        known = bounded(limits, "lang")
        survivors = _settled(pieces if left is None else pieces.join(known, "lang", "left_semi"), counts, limits, least, half)
        # A list is settled when it is full, or when nothing lies below its limit.
        full = survivors.groupBy("lang").agg(F.count("*").alias("held"))
        state = stored(limits.join(full, "lang", "left").select("lang", ((F.col("held") >= most) | (F.col("limit") == 0)).alias("done")), "state")
        done = survivors.join(bounded(state.filter("done"), "lang"), "lang", "left_semi").drop("limit")
        found = done if found is None else found.unionByName(done)
        left = state.filter("NOT coalesce(done, false)").select("lang")
        if not left.limit(1).count():
            break
        rank *= WIDER
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(bounded(counts.totals, "lang"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
