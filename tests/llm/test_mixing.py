from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from markspan.llm import mixing
from tests.llm.helpers import documents, frame


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += words(text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    return dict(zip(order, mixing.water_fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2.0), strict=True)), size


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.water_fill([10, 100], [3, 1], 165, 2) == pytest.approx([20, 145])
    assert mixing.water_fill([0, 5], [3, 1], 7.5, 2) == pytest.approx([0, 7.5])
    assert mixing.water_fill([], [], 0, 2) == []


@pytest.mark.parametrize("clash", [False, True])
def test_contract(spark, clash):
    rows = documents(300)
    got = mixing.mix_documents(frame(spark, rows, clash)).collect()
    want, size = targets(rows)
    source = {(i, words(t)): s for i, t, _, s, _ in rows}
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, words(t)) for i, t, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.target == pytest.approx(want[s]) and r.source_size == size[s]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    largest = max(words(t) for _, t, _, s, _ in rows if s == "src0")
    assert abs(taken["src0"] - want["src0"]) <= largest / 2


def test_reruns_agree_at_any_partitioning_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 7)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = frame(spark, documents(200))
    runs = [Counter(map(tuple, mixing.mix_documents(df.repartition(k)).collect())) for k in (1, 5)]
    assert runs[0] == runs[1] and sum(runs[0].values()) == df.count()
    want, _ = targets(documents(200))
    got = {r.source: r.t for r in mixing.mix(df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    assert abs(got["src0"] - want["src0"]) < 200


def test_rounding_keeps_expectations_and_sums():
    rng = random.Random(0)
    items = [(i, i, rng.randint(1, 50), rng.random()) for i in range(40)]
    total = sum(s * p for *_, s, p in items)
    mean = [0.0] * 40
    for seed in range(3000):
        out = {i: p for i, p, _ in mixing.pivot(items, seed, False)}
        assert sorted(out) == list(range(40)) and sum(p not in (0.0, 1.0) for p in out.values()) <= 1
        assert sum(s * out[i] for i, _, s, _ in items) == pytest.approx(total)
        for i, p in out.items():
            mean[i] += p / 3000
    assert max(abs(m - p) for m, (*_, p) in zip(mean, items, strict=True)) < 0.05


def test_mixed_rows_repeat_whole_rows(spark):
    rows = documents(80)
    df = frame(spark, rows)
    got = Counter(r.doc_id for r in mixing.mixed_rows(df).collect())
    copies = Counter()
    for r in mixing.mix_documents(df).collect():
        if r["size"]:
            copies[r.doc_id] += r.taken // r["size"]
    assert {i: n for i, n in got.items() if copies[i]} == {i: n for i, n in copies.items() if n}
    assert mixing.mixed_rows(df).columns == df.columns


def test_rows_equal_in_part_or_whole(spark, monkeypatch):
    """Equal ids with different texts or columns, and a third of all rows equal: each row has at most one copy more than another of its source."""
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(1, f"text {chr(97 + i)} of six words here", "en", "a", i) for i in range(9)] + [(None, "the same null row", "en", "a", 3)] * 20 + [(2, "one", "en", "b", 1), (2, "one", "fr", "b", 1), (3, None, "en", None, None)] * 5
    rows += [(4, "size five words in all", "en", "c", 1)] * 31
    df = frame(spark, rows)
    own = df.withColumns({c: F.lit(i) for i, c in enumerate(("_size", "_copies", "_n", "_copy", "_rid", "_times", "_nth", "_part", "n", "first", "more", "size", "tie"))})
    got = mixing.mixed_rows(own)
    assert got.columns == own.columns and {tuple(r)[5:] for r in got.collect()} == {tuple(range(13))}
    taken, there = Counter(tuple(r)[:5] for r in got.collect()), Counter(rows)
    want, size = targets(rows)
    for row, n in there.items():
        if size[row[3]]:
            low = int(want[row[3]] / size[row[3]])
            assert low * n <= taken[row] <= (low + 1) * n
    for source in "abc":
        words_taken = sum(words(r[1]) * n for r, n in taken.items() if r[3] == source)
        assert abs(words_taken - want[source]) <= 6
    again = Counter(tuple(r)[:5] for r in mixing.mixed_rows(own.repartition(7)).collect())
    assert again == taken
    digest = Counter((r.doc_id, r["size"]) for r in mixing.mix_documents(df).collect())
    assert digest == Counter((r[0], words(r[1])) for r in rows)


def brute_water_fill(sizes, weights, total, most):
    """Targets by bisection on the level: each is the smaller of weight * level and its cap."""
    lo, hi = 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(w * level, most * s) for s, w in zip(sizes, weights)) < total else (lo, level)
    return [min(w * lo, most * s) for s, w in zip(sizes, weights)]


def test_water_fill_equals_bisection():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.choice([0, rng.randint(1, 10), rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 12))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        if sum(sizes):
            assert mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2.0) == pytest.approx(brute_water_fill(sizes, weights, 1.5 * sum(sizes), 2.0), abs=1e-3)


def test_empty(spark):
    df = frame(spark, documents(5)).limit(0)
    assert mixing.mix_documents(df).count() == 0 and mixing.mixed_rows(df).count() == 0
