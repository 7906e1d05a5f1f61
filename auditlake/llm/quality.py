"""Quality of texts by ordinal regression with cumulative links.

A text's score is a sum of weights shared by all grades: one weight per hashed token (words and runs of
signs, in lower case, averaged over the text) and a few for its make-up (shares of capitals, signs,
numbers and repeated words, length of words). Ordered thresholds turn the score into the probability of
each grade: P(grade <= k) = logistic(threshold k - score). That gives an expected grade and the
probability of reaching the grade that is selected for.

The model is fitted on at most ``SAMPLE`` rated rows, those with the smallest hashes of their id; every
text is scored whole. Null and empty texts have no tokens and a score of zero. Rows without a grade or
with a null text are not fitted on. Without rated rows every grade is equally likely and all is kept.
Repeated rows get equal scores; other columns are kept, but for one named like a new one, which is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.tokens import HASHER, LETTER, NUMBER, OTHER, SPACE, code_points, runs, slices

# Rated rows the model is fitted on at most; weights for hashed tokens; steps and shrinkage of the fit.
SAMPLE, BUCKETS, STEPS, SHRINKAGE = 12_000, 1 << 17, 160, 1e-4
MAKE_UP = 7


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the tokens, where each text's tokens start, and each text's make-up."""
    points, starts = code_points(texts)
    lower = [t.lower() for t in texts]
    low, low_starts = code_points(lower)
    begin, kind = runs(low, low_starts)
    end = np.append(begin[1:], len(low))
    token = kind != SPACE
    begin, end, kind = begin[token], end[token], kind[token]
    hashes = HASHER.of(HASHER.sums(low), begin, end)
    offsets = np.searchsorted(begin, low_starts)
    count = np.maximum(np.diff(offsets), 1)
    again = np.zeros(len(hashes), bool)
    for back in (1, 2):
        again[back:] |= hashes[back:] == hashes[:-back]

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = np.searchsorted(low_starts, begin, "right") - 1
    first = begin == low_starts[inside]
    capitals = np.concatenate(([0], np.cumsum((points >= 65) & (points <= 90))))
    size = np.maximum(np.diff(starts), 1)
    again &= ~first
    make_up = np.stack([
        (capitals[starts[1:]] - capitals[starts[:-1]]) / size,
        total(again) / count,
        total(kind == OTHER) / count,
        total(kind == NUMBER) / count,
        total(np.where(kind == LETTER, end - begin, 0)) / count / 10,
        total(np.where(kind == OTHER, end - begin, 0)) / size,
        np.log1p(np.diff(offsets)) / 10,
    ], axis=1)
    return (hashes >> np.uint64(64 - 17)).astype(np.int32), offsets, make_up


@dataclass(frozen=True)
class Model:
    """Weights of the hashed tokens and of the make-up, its usual size, and the ordered thresholds."""

    tokens: np.ndarray
    make_up: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        found = []
        for _, part in slices(texts):
            buckets, offsets, make_up = features(part)
            sums = np.concatenate(([0.0], np.cumsum(self.tokens[buckets], dtype=np.float64)))
            mean = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
            dense = ((make_up - self.centre) / self.scale) @ self.make_up
            found.append(np.where(np.diff(offsets) > 0, mean + dense, 0.0))
        return np.concatenate(found) if found else np.zeros(0)

    def reaching(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 to the highest, a row per text."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(buckets: np.ndarray, offsets: np.ndarray, make_up: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood with shrinkage, by gradient steps of adapted size (Adam)."""
    n = len(grades)
    centre = make_up.mean(axis=0) if n else np.zeros(MAKE_UP)
    scale = np.maximum(make_up.std(axis=0), 1e-3) if n else np.ones(MAKE_UP)
    if not n:
        return Model(np.zeros(BUCKETS), np.zeros(MAKE_UP), centre, scale, np.full(n_grades - 1, -10.0))
    dense = np.clip((make_up - centre) / scale, -8, 8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    share = 1 / np.maximum(np.diff(offsets), 1)[owner]
    below = np.array([(np.sum(grades <= k) + 1) / (n + 2) for k in range(n_grades - 1)])
    start = np.log(below / (1 - below))
    # Thresholds are the first one and the logarithms of the gaps above it, so that they stay ordered.
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    state = [np.zeros(BUCKETS), np.zeros(MAKE_UP), start[:1].copy(), gaps]
    slope, square = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for step in range(1, STEPS + 1):
        tokens, weights, first, gaps = state
        thresholds = first[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(owner, tokens[buckets] * share, n) + dense @ weights
        edges = np.concatenate((np.zeros((n, 1)), _logistic(thresholds[None, :] - score[:, None]), np.ones((n, 1))), axis=1)
        row = np.arange(n)
        upper, lower = edges[row, grades + 1], edges[row, grades]
        likely = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        by_score = (up - down) / n
        by_threshold = np.zeros(n_grades + 1)
        np.add.at(by_threshold, grades + 1, -up / n)
        np.add.at(by_threshold, grades, down / n)
        by_threshold = by_threshold[1:-1]
        tail = np.cumsum(by_threshold[::-1])[::-1]
        slopes = [
            np.bincount(buckets, by_score[owner] * share, BUCKETS) + SHRINKAGE / n * tokens,
            dense.T @ by_score + SHRINKAGE * weights,
            tail[:1],
            tail[1:] * np.exp(gaps),
        ]
        for i, g in enumerate(slopes):
            slope[i] = 0.9 * slope[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            rate = (0.4, 0.08, 0.08, 0.08)[i]
            state[i] = state[i] - rate * (slope[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
    tokens, weights, first, gaps = state
    return Model(tokens, weights, centre, scale, first[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def train(documents: DataFrame, ratings: DataFrame, n_grades: int, id: str = "doc_id", text: str = "text", grade: str = "grade") -> Model:
    """Fit on the texts of rated documents; ``ratings`` has grades from 0 by id."""
    usable = ratings.filter(F.col(id).isNotNull() & F.col(grade).isNotNull())
    # The bounded sample is chosen among the ratings, so that it can be sent to where the texts are.
    chosen = usable.orderBy(F.xxhash64(id), id, grade).limit(SAMPLE).select(id, F.col(grade).cast("int").alias("_grade"))
    texts = documents.filter(F.col(text).isNotNull()).select(id, F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), id).select("text", F.col("_grade").alias("grade"))

    def run(batches):
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            for _, part in slices(texts):
                buckets, offsets, make_up = features(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([buckets[b:e].tobytes() for b, e in zip(offsets, offsets[1:], strict=False)], pa.binary()),
                        pa.array([row.tobytes() for row in make_up], pa.binary()),
                        batch.column("grade").slice(at, len(part)),
                    ],
                    names=["buckets", "make_up", "grade"],
                )
                at += len(part)

    # Texts become features on the executors; what the driver fits on is bounded by the sample.
    got = sample.mapInArrow(run, "buckets binary, make_up binary, grade int").toArrow()
    parts = [np.frombuffer(b, np.int32) for b in got["buckets"].to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    make_up = np.array([np.frombuffer(m, np.float64) for m in got["make_up"].to_pylist()]).reshape(-1, MAKE_UP)
    return fit(np.concatenate([np.zeros(0, np.int32), *parts]), offsets, make_up, np.array(got["grade"].to_pylist(), np.int64), n_grades)


def rating(model: Model, select: int, text: str = "text") -> Column:
    """``expected_grade`` and ``tail_probability``, the probability of grade ``select`` or more."""

    @F.arrow_udf("struct<expected_grade: double, tail_probability: double>")
    def judge(values: pa.Array) -> pa.Array:
        reaching = model.reaching(model.scores([t or "" for t in values.to_pylist()]))
        return pa.StructArray.from_arrays(
            [pa.array(reaching.sum(axis=1)), pa.array(reaching[:, select - 1])], names=["expected_grade", "tail_probability"]
        )

    return judge.asNondeterministic()(F.col(text))  # so that a filter on it does not work it out twice


def rate(documents: DataFrame, model: Model, select: int, text: str = "text") -> DataFrame:
    """Add the two columns of ``rating``."""
    rated = documents.drop("expected_grade", "tail_probability").withColumn("_rating", rating(model, select, text))
    return rated.select("*", "_rating.expected_grade", "_rating.tail_probability").drop("_rating")


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades from two labels: 0 for poor texts, 1 for good ones that are toxic, 2 for other good ones."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality == 1, 2)
