from __future__ import annotations

import math
import random

import numpy as np
import pytest

from markspan.llm import ordinal_quality as Q
from tests.llm.helpers import documents, frame, sentence

LABELS = "doc_id long, quality int, toxic int"


def rated(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = sentence(rng, "en", 50).split()
        grade = rng.choice([0, 1, 2, 2, 2])
        for k in rng.sample(range(50), 6):
            if grade == 0:
                words[k] = rng.choice(["vile", "awful", "nasty"])
            if grade == 1:
                words[k] += rng.choice(["###", "$$$"])
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(grade != 1), int(grade == 0)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rated()
    unseen = [x for i, x in enumerate(labels) if i % 3]
    got = {r.doc_id: r for r in Q.grade_documents(frame(spark, docs), spark.createDataFrame(unseen, LABELS)).collect()}
    grade = {i: 0 if t else 1 if not q else 2 for i, q, t in labels}
    held = range(0, 600, 3)
    assert np.mean([round(got[i].expected_grade) == grade[i] for i in held]) > 0.9
    assert np.mean([got[i].kept for i in held if grade[i] == 2]) > 0.97
    assert np.mean([got[i].kept for i in held if grade[i] < 2]) < 0.1


def log_likelihood(thresholds, grade, score):
    """Independent of the operator: log of P(Y <= grade) - P(Y <= grade - 1) under logistic noise."""
    cumulative = [0.0, *(1 / (1 + math.exp(-(t - score))) for t in thresholds), 1.0]
    return math.log(cumulative[grade + 1] - cumulative[grade])


def test_slopes_equal_differences_of_the_likelihood():
    rng = random.Random(1)
    for _ in range(200):
        thresholds = np.sort([rng.uniform(-3, 3) for _ in range(3)]) + np.array([0, 0.1, 0.2])
        grade, score, e = rng.randrange(4), rng.uniform(-3, 3), 1e-6
        by_score, by_threshold = Q.slopes(thresholds, grade, score)
        assert abs(by_score - (log_likelihood(thresholds, grade, score + e) - log_likelihood(thresholds, grade, score - e)) / (2 * e)) < 1e-6
        near = dict(by_threshold)
        for k in range(3):
            up, down = thresholds.copy(), thresholds.copy()
            up[k] += e
            down[k] -= e
            assert abs(near.get(k, 0.0) - (log_likelihood(up, grade, score) - log_likelihood(down, grade, score)) / (2 * e)) < 1e-5


def test_probabilities_follow_the_model():
    model = Q.OrdinalModel(np.random.default_rng(2).normal(size=Q.DIMS).astype(np.float32), np.array([-0.5, 0.7]))
    text = "Some words of a Text ### with things things"
    where, value = Q.features(text)
    score = float(sum(float(model.weights[i]) * float(v) for i, v in zip(where, value, strict=True)))
    p = [math.exp(log_likelihood(model.thresholds, g, score)) for g in range(3)]
    assert model.grade(text) == pytest.approx((p[1] + 2 * p[2], p[2]), abs=1e-5)


def test_fit_comes_near_the_best_likelihood():
    """Three features and three grades: as good as plain gradient ascent to the end."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        x = rng.normal(size=3).astype(np.float32)
        y = float(x @ [1.0, -0.5, 0.0] + rng.logistic())
        rows.append((int(y > -1) + int(y > 1), np.array([7, 8, 9], np.int32), x))
    model = Q.fit(rows, 3)
    assert model.thresholds[0] < model.thresholds[1]
    w, t = np.zeros(3), np.array([-1.0, 1.0])
    for _ in range(400):
        gw, gt = np.zeros(3), np.zeros(2)
        for g, _, x in rows:
            by_score, near = Q.slopes(t, g, float(w @ x))
            gw += by_score * x
            for k, s in near:
                gt[k] += s
        w, t = w + gw / 200, t + gt / 200
    best = sum(log_likelihood(t, g, float(w @ x)) for g, _, x in rows)
    found = sum(log_likelihood(model.thresholds, g, float(model.weights[[7, 8, 9]] @ x)) for g, _, x in rows)
    assert found > best - 0.02 * abs(best)


def test_one_id_on_many_rows_is_fitted_once(spark):
    docs, labels = rated(80)
    rows = spark.createDataFrame([(d[0], d[1]) for d in docs], "doc_id long, text string").union(spark.range(3000).selectExpr("1L", "concat('again ', id % 3)"))
    seen = []
    fit = Q.fit
    try:
        Q.fit = lambda rows, grades: seen.append(len(rows)) or fit(rows, grades)
        assert Q.train(rows, spark.createDataFrame(labels, LABELS)) is not None
        assert Q.train(rows, spark.createDataFrame(labels, LABELS), sample=20) is not None
    finally:
        Q.fit = fit
    assert seen == [64, 16]


def test_odd_rows(spark):
    rows = documents(30)
    labels = [(i, i % 2, 0) for i in range(30)] + [(1, 0, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (10**6, 1, 0)]
    labels = spark.createDataFrame(labels, LABELS)
    got = Q.grade_documents(frame(spark, rows, True), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert len({(r.expected_grade, r.kept) for r in got if r.doc_id in (33, 34)}) == 1
    assert Q.grade_documents(frame(spark, rows).limit(0), labels).count() == 0
    free = Q.grade_documents(frame(spark, rows), labels.limit(0)).collect()
    assert len(free) == len(rows) and all(r.kept and r.expected_grade is None for r in free)
