"""Ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.samples import bounded_sample
from markspan.llm.tables import materialize, ship

DIMS = 1 << 18
#: Bound of the labelled sample that is fitted: documents, by a hash of doc_id, and bytes of their texts.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 8_000, 64 << 20
EPOCHS = 15
#: A feature counts if it is in so many of the fitted documents (fewer in a small sample).
MIN_DOCUMENTS = 20
#: Share of calibration texts of the top grade that selection may lose (to the nearest text), and the highest limit that this may set.
MISS, HIGHEST_LIMIT = 0.002, 0.8
WORD_VALUE, SHARE_VALUE = 0.15, 5.0
_OTHER = regex.compile(r"[^\p{L}]+")


def _place(text: str, kind: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), kind) & (DIMS - 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text.

    Its words in lower case without other characters, and their first four and
    five letters, each once; the share of words with each run of other
    characters, of words in capitals, and of words that repeat the one before.
    """
    words = (text or "").split()
    present: set[int] = set()
    shares: Counter = Counter()
    for word, n in Counter(words).items():
        letters = word.lower()
        if not word.isalpha():
            for run in set(_OTHER.findall(word)):
                shares[_place(run, 1)] += n
            letters = _OTHER.sub("", letters)
        if letters:
            present.add(_place(letters, 0))
            if len(letters) > 4:
                present.add(_place(letters[:5], 2))
                present.add(_place(letters[:4], 3))
            if len(letters) > 1 and word.isupper():
                shares[_place("capitals", 4)] += n
    if repeats := sum(a == b for a, b in zip(words, words[1:], strict=False)):
        shares[_place("repeats", 4)] += repeats
    values = np.full(len(present) + len(shares), WORD_VALUE, np.float32)
    values[len(present) :] = SHARE_VALUE * np.sqrt(np.fromiter(shares.values(), np.float32, len(shares)) / max(1, len(words)))
    return np.fromiter((*present, *shares), np.int32, len(values)), values


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    least_tail: float = 0.5

    def grade(self, text: str | None) -> tuple[float, float]:
        """(expected grade, probability of the top grade)."""
        where, value = features(text)
        above = 1.0 - _sigmoid(self.thresholds - float(self.weights[where] @ value))
        return float(above.sum()), float(above[-1])


def slopes(thresholds: np.ndarray, grade: int, score: float) -> tuple[float, list[tuple[int, float]]]:
    """Derivatives of the log-likelihood of ``grade`` by the score, and by the thresholds next to it (index, derivative)."""
    last = len(thresholds)
    upper = _sigmoid(thresholds[grade] - score) if grade < last else 1.0
    lower = _sigmoid(thresholds[grade - 1] - score) if grade else 0.0
    span = max(upper - lower, 1e-9)
    near = [(grade, upper * (1 - upper) / span), (grade - 1, -lower * (1 - lower) / span)]
    return upper + lower - 1.0, [(k, slope) for k, slope in near if 0 <= k < last and slope]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int = EPOCHS, rate: float = 0.5, ridge: float = 1e-3) -> OrdinalModel:
    """Adaptive gradient ascent of the likelihood, row by row in a fixed order, averaged over the later epochs; thresholds stay in order."""
    weights, squares, sums = np.zeros(DIMS), np.full(DIMS, 1e-3), np.zeros(DIMS)
    share = np.cumsum(np.bincount([r[0] for r in rows], minlength=grades) + 1.0)
    share = share[:-1] / share[-1]
    thresholds = np.log(share / (1 - share))
    threshold_sums, pull = np.zeros(grades - 1), np.ones(grades - 1)
    rng = np.random.default_rng(5)
    for epoch in range(epochs):
        for at in rng.permutation(len(rows)):
            grade, where, value = rows[at]
            score = weights[where] @ value
            by_score, by_threshold = slopes(thresholds, grade, score)
            step = by_score * value - ridge * weights[where]
            squares[where] += step * step
            weights[where] += rate * step / np.sqrt(squares[where])
            for k, slope in by_threshold:
                pull[k] += slope * slope
                thresholds[k] += 0.2 * slope / np.sqrt(pull[k])
            for k in range(1, grades - 1):
                thresholds[k] = max(thresholds[k], thresholds[k - 1] + 1e-3)
        if epoch >= epochs // 3:
            sums += weights
            threshold_sums += thresholds
    used = epochs - epochs // 3
    return OrdinalModel((sums / used).astype(np.float32), threshold_sums / used)


def _frequent(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The rows without features that few of them have."""
    found = np.zeros(DIMS, np.int32)
    for _, where, _ in rows:
        np.add.at(found, where, 1)
    keep = found >= min(MIN_DOCUMENTS, max(2, len(rows) // 300))
    return [(grade, where[keep[where]], value[keep[where]]) for grade, where, value in rows]


def rating(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 neither toxic nor good, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel | None:
    """Fit on up to ``sample`` labelled documents; a fifth of them sets the least tail probability.

    Labels that disagree count as the lower grade. A test of a hash leaves some
    four times the sample of labelled ids, which are broadcast to the documents;
    a doc_id counts once, however many rows it has. Hashed features, not texts,
    come to the driver, as bounded as the texts are. None without two different
    grades.
    """
    graded = labels.where("doc_id IS NOT NULL").select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("grade")).where("grade IS NOT NULL")
    rated = materialize(graded.groupBy("doc_id").agg(F.min("grade").alias("grade")), "ratings")
    every = max(1, rated.count() // (4 * sample))
    some = rated.where(F.pmod(F.xxhash64(F.lit("rated"), "doc_id"), F.lit(every)) == 0)

    def hashed(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([w.tobytes() for w, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["doc_id", "grade", "places", "weights"],
            )

    ship(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    known = texts.join(F.broadcast(some), "doc_id").select(F.lit(0).alias("all"), F.col("doc_id"), "text")
    joined = bounded_sample(known, "all", sample, sample_bytes).join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text")
    got = joined.mapInArrow(hashed, "doc_id long, grade int, places binary, weights binary").collect()
    rows = [(r["grade"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in sorted(got, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["places"])))]
    if len({r[0] for r in rows}) < 2:
        return None
    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    model = fit(_frequent(used), 3)
    tops = sorted(float(1.0 - _sigmoid(model.thresholds[-1] - float(model.weights[w] @ v))) for g, w, v in held if g == 2)
    if tops:
        model.least_tail = min(HIGHEST_LIMIT, tops[round(MISS * len(tops))])
    return model


def grade_documents(documents: DataFrame, labels: DataFrame, model: OrdinalModel | None = None) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every whole text.

    Grades: 0 toxic, 1 poor, 2 good. kept: the probability of grade 2 is no less
    than the limit that the calibration texts set. Null and empty texts have no
    features and are graded by the thresholds alone. Without labels of two
    grades nothing is graded and all is kept. Repeated rows are graded alike,
    other columns are ignored, an empty table gives an empty result.
    """
    model = model or train(documents, labels)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.grade(t.as_py()) for t in batch.column(1)]
            tail = [t for _, t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e for e, _ in found], pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= shared.value.least_tail for t in tail], pa.bool_())],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    return base.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
