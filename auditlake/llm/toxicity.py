"""Toxicity of texts by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause as symbols and are composed into one machine. The lexical
one turns words into insults (with a weight), threats, targets, negations, reports or other words; the
ones for negation, reported speech, targets and threats rewrite those symbols by what stands near them
in the clause: an insult soon after a negation is a negated one, after a verb of saying a reported one,
close to a target a targeted one; a threat needs a target. The weights that the machine puts out add up
per kind of match, and a logistic function of these sums is the score.

Threats, targets, negations and reports are fixed words of four languages. Insults are learned: words
and beginnings of words that labelled toxic texts hold far more often than others. Lexicon and logistic
weights are fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of their id; each
distinct text counts once, as toxic if any of its labels says so. Only texts are read for a score.

Null and empty texts match nothing and get the score of a text without matches. Texts are read whole.
Rows without a label or with a null text are not learned from; without labelled rows of both kinds the
lexicon is empty and every score is the share of toxic labels, counted with one more of either kind.
Other columns are kept, but for one named ``score``, which is replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import stored
from auditlake.llm.tokens import HASHER, LETTER, code_points, runs, slices

# Labelled rows learned from at most; entries of the lexicon at most.
SAMPLE, ENTRIES = 16_000, 20_000
# Lengths of word beginnings that may be entries; 0 stands for whole words.
STEMS = (0, 4, 5, 6)
# An entry stands in so many toxic texts, and is so much more frequent in them (a logarithm).
LEAST_TEXTS, LEAST_ODDS = 3, 2.5
# Words that a negation or a target reaches over.
NEAR = 4

# Words of English, German, French and Spanish.
THREATS = (
    "kill hurt beat stab shoot murder destroy strangle hang burn punch töten umbringen schlagen erschießen "
    "tuer frapper égorger brûler matar golpear quemar disparar"
).split()
TARGETS = (
    "you your yours he she him her they them people everyone anyone du dich dir euch ihr ihn sie leute "
    "tu toi te vous lui eux gens ti usted ustedes él ella ellos ellas gente"
).split()
NEGATIONS = "not no never neither nobody nicht kein keine keiner nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = (
    "said says say called calls wrote writes quoted quotes claimed claims reported sagte sagt schrieb nannte "
    "dit disait écrit appelé dijo dice escribió llamó"
).split()
CLAUSE_ENDS = ".!?;\n"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "o", "I", "T", "Y", "N", "R"
# What the composed machine counts.
NEGATED, REPORTED, TARGETED, THREATENED = "i", "q", "A", "X"
KINDS = (INSULT, NEGATED, REPORTED, TARGETED, THREATENED)


# --- transducers ----------------------------------------------------------------------
# A transducer is a start state and a function from state and symbol to state and symbol; states are
# small numbers, so that composing it with others gives a finite table.


def negation(state: int, symbol: str) -> tuple[int, str]:
    """State: words left that a negation reaches."""
    if symbol == NEGATION:
        return NEAR, symbol
    return max(0, state - 1), NEGATED if symbol == INSULT and state else symbol


def reported_speech(state: int, symbol: str) -> tuple[int, str]:
    """State: 1 after a verb of saying, to the end of the clause."""
    if symbol == REPORT:
        return 1, symbol
    return state, REPORTED if state and symbol in (INSULT, NEGATED, THREAT) else symbol


def target(state: int, symbol: str) -> tuple[int, str]:
    """State: words left that a target reaches."""
    if symbol == TARGET:
        return NEAR, symbol
    return max(0, state - 1), TARGETED if symbol == INSULT and state else symbol


def threat(state: int, symbol: str) -> tuple[int, str]:
    """State: words left in which a target completes a threat."""
    if symbol == THREAT:
        return NEAR, OTHER
    if symbol == TARGET and state:
        return 0, THREATENED
    return max(0, state - 1), symbol


def compose(*transducers) -> list[dict[str, tuple[int, str]]]:
    """One machine that passes each symbol through all transducers; state 0 is the start."""
    start = (0,) * len(transducers)
    number, table, ahead = {start: 0}, [], deque([start])
    while ahead:
        states = ahead.popleft()
        row = {}
        for symbol in (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT):
            after, out = [], symbol
            for step, state in zip(transducers, states, strict=True):
                state, out = step(state, out)
                after.append(state)
            if tuple(after) not in number:
                number[tuple(after)] = len(number)
                ahead.append(tuple(after))
            row[symbol] = (number[tuple(after)], out)
        table.append(row)
    return table


MACHINE = compose(negation, reported_speech, target, threat)


def match_clause(symbols: list[str], weights: list[float]) -> list[tuple[str, float]]:
    """Kind and weight of each match in a clause."""
    state, found = 0, []
    for symbol, weight in zip(symbols, weights, strict=True):
        state, out = MACHINE[state][symbol]
        if out in KINDS:
            found.append((out, weight if symbol == INSULT else 1.0))
    return found


# --- words ----------------------------------------------------------------------------


def _words(texts: list[str]):
    """Sums for hashing, start and end of every word, and where each text's words start."""
    points, starts = code_points([t.lower() for t in texts])
    begin, kind = runs(points, starts)
    end = np.append(begin[1:], len(points))
    begin, end = begin[kind == LETTER], end[kind == LETTER]
    return points, HASHER.sums(points), begin, end, np.searchsorted(begin, starts)


def _hashes(sums, begin, end, stem: int) -> np.ndarray:
    """Hashes of the words or of their beginnings; 0 for words no longer than the beginning."""
    if stem == 0:
        return HASHER.of(sums, begin, end)
    return np.where(end - begin > stem, HASHER.of(sums, begin, np.minimum(begin + stem, end)), np.uint64(0))


def _fixed() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fixed words in ascending order, and the symbol of each."""
    listed = [(w, s) for ws, s in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in ws]
    _, sums, begin, end, _ = _words([w for w, _ in listed])
    hashes = _hashes(sums, begin, end, 0)
    order = np.argsort(hashes)
    return hashes[order], np.array([s for _, s in listed])[order]


FIXED, FIXED_SYMBOLS = _fixed()


def _found(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the table, and whether it is there."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


@dataclass(frozen=True)
class Grammar:
    """Entries by length of beginning, in ascending order of hashes, their weights, and the logistic."""

    entries: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    bias: float

    def sums(self, texts: list[str]) -> np.ndarray:
        """For each text and kind of match the sum of the weights, on a logarithmic scale."""
        found = np.zeros((len(texts), len(KINDS)))
        for first, part in slices(texts):
            self._add(found[first : first + len(part)], part)
        return np.log1p(found)

    def _add(self, found: np.ndarray, texts: list[str]) -> None:
        points, sums, begin, end, offsets = _words(texts)
        if not len(begin):
            return
        insult = np.zeros(len(begin))
        for stem, (hashes, weights) in self.entries.items():
            at, there = _found(hashes, _hashes(sums, begin, end, stem))
            insult[there] = np.maximum(insult[there], weights[at[there]])
        at, there = _found(FIXED, _hashes(sums, begin, end, 0))
        symbols = np.where(there, FIXED_SYMBOLS[at], OTHER)
        symbols[insult > 0] = INSULT
        marks = np.isin(points, [ord(c) for c in CLAUSE_ENDS], kind="table")
        clause = np.cumsum(marks)[begin] + np.searchsorted(offsets, np.arange(len(begin)), "right")
        # Only clauses with an insult or a threat can match.
        worth = np.unique(clause[(symbols == INSULT) | (symbols == THREAT)])
        lo, hi = np.searchsorted(clause, worth), np.searchsorted(clause, worth, "right")
        for b, e in zip(lo.tolist(), hi.tolist(), strict=True):
            text = np.searchsorted(offsets, b, "right") - 1
            for kind, weight in match_clause(symbols[b:e].tolist(), insult[b:e].tolist()):
                found[text, KINDS.index(kind)] += weight

    def scores(self, texts: list[str]) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (self.sums(texts) @ self.weights + self.bias)))


# --- learning -------------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a batch each entry stands."""
    for batch in batches:
        texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, part in slices(texts):
            _, sums, begin, end, offsets = _words(part)
            owner = np.repeat(np.arange(len(part)), np.diff(offsets))
            label = toxic[first : first + len(part)]
            for stem in STEMS:
                hashes = _hashes(sums, begin, end, stem)
                long = hashes != 0
                order = np.lexsort((hashes[long], owner[long]))
                h, o = hashes[long][order], owner[long][order]
                once = np.append(True, (np.diff(h) != 0) | (np.diff(o) != 0))[: len(h)]
                entry, at = np.unique(h[once], return_inverse=True)
                bad = np.bincount(at, label[o[once]] == 1, len(entry)).astype(np.int64)
                every = np.bincount(at, minlength=len(entry))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(entry), stem, np.int32)), pa.array(entry.view(np.int64)), pa.array(bad), pa.array(every - bad)],
                    names=["stem", "entry", "bad", "good"],
                )


def _logistic_fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.5) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic regression whose weights are drawn towards zero."""
    x = np.hstack([x, np.ones((len(x), 1))])
    held = np.append(np.full(x.shape[1] - 1, shrinkage), 1e-3)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
        slope = x.T @ (p - y) + held * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), slope)
    return w[:-1], float(w[-1])


def learn(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """A grammar from labelled texts; ``label`` is 1 for toxic ones and 0 for others."""
    usable = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1))
    # The bounded sample is chosen among the labels, so that it can be sent to where the texts are.
    chosen = usable.orderBy(F.xxhash64(id), id, label).limit(SAMPLE).select(id, F.col(label).cast("int").alias("_toxic"))
    texts = documents.filter(F.col(text).isNotNull()).select(id, F.col(text).alias("text"))
    joined = texts.join(F.broadcast(chosen), id).select("text", F.col("_toxic").alias("toxic"))
    sample = stored(joined.groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Grammar({}, np.zeros(len(KINDS)), float(np.log((bad + 1) / (good + 1))))
    counted = sample.mapInArrow(_counts, "stem int, entry bigint, bad bigint, good bigint")
    entries = counted.groupBy("stem", "entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5) * F.lit(good / bad))
    chosen = entries.withColumn("odds", odds).filter((F.col("bad") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS))
    got = chosen.orderBy(F.desc(F.col("odds") * F.log("bad")), "stem", "entry").limit(ENTRIES).toArrow()
    stems, hashes, weights = (got[c].to_numpy() for c in ("stem", "entry", "odds"))
    table = {}
    for stem in STEMS:
        own = hashes[stems == stem].view(np.uint64) if len(hashes) else np.zeros(0, np.uint64)
        order = np.argsort(own)
        table[stem] = (own[order], weights[stems == stem][order])
    grammar = Grammar(table, np.zeros(len(KINDS)), 0.0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = grammar.sums(batch.column("text").to_pylist())
            columns = [pa.array(c) for c in sums.T]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], names=[*(f"k{i}" for i in range(len(KINDS))), "toxic"])

    # A few numbers per row of the bounded sample.
    shape = ", ".join(f"k{i} double" for i in range(len(KINDS))) + ", toxic int"
    got = sample.mapInArrow(measured, shape).toArrow()
    x = np.stack([got[f"k{i}"].to_numpy() for i in range(len(KINDS))], axis=1)
    order = np.lexsort((*x.T, got["toxic"].to_numpy()))
    return Grammar(table, *_logistic_fit(x[order], got["toxic"].to_numpy()[order].astype(float)))


def score(documents: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Add ``score``, from 0 to 1."""

    @F.arrow_udf("double")
    def judge(values: pa.Array) -> pa.Array:
        return pa.array(grammar.scores([t or "" for t in values.to_pylist()]), pa.float64())

    return documents.drop("score").withColumn("score", judge.asNondeterministic()(F.col(text)))
