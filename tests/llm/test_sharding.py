from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from markspan.llm import sharding
from tests.llm.helpers import documents, frame


@pytest.mark.parametrize("clash", [False, True])
def test_digest(spark, clash):
    rows = documents()
    got = sharding.shard_documents(frame(spark, rows, clash), 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_empty_and_fewer_rows_than_shards(spark):
    df = frame(spark, documents())
    assert sharding.shard_documents(df.limit(0)).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shard_documents(df.limit(3), 24).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_rows_pass_whole_through_several_blocks(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as name", "1 as shard", "2 as slot")
    got = sharding.shuffle_into_shards(df, 3, block_rows=50).collect()
    assert sorted((r.id, r.name) for r in got) == sorted((i, str(i)) for i in range(1000))
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (333, 334)


def test_columns_of_any_name_pass_through(spark):
    df = spark.range(40).selectExpr("id", "id + 1 as _rid", "id + 2 as _Block", "id + 3 as _key", "id + 4 as _first", "-1 as slot", "array(id) as _place")
    got = sharding.shuffle_into_shards(df, 3, block_rows=5)
    assert got.columns == ["id", "_rid", "_Block", "_key", "_first", "_place", "shard", "slot"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == [(i, i + 1, i + 2, i + 3, i + 4, [i]) for i in range(40)]
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(s, k) for s in range(3) for k in range(13 + (s < 1))]


def test_shuffle_is_uniform(spark):
    """Over seeds each row is in each of 3 shards and 2 slots about as often: chi-square of 6 cells."""
    df = spark.range(6).coalesce(2)
    seen = Counter()
    for seed in range(60):
        for r in sharding.shuffle_into_shards(df, 3, seed=seed).collect():
            seen[r.id, r.shard, r.slot] += 1
    chi = sum((seen[i, s, k] - 10) ** 2 / 10 for i in range(6) for s in range(3) for k in range(2))
    assert chi < 60  # 25 degrees of freedom: 99.99 %


def test_matrix_sums():
    sizes, targets = np.array([5, 0, 17, 9, 3]), np.array([10, 10, 7, 7])
    rows = [sharding.matrix_row(sizes, targets, p, 3) for p in range(5)]
    assert [int(r.sum()) for r in rows] == sizes.tolist() and np.sum(rows, axis=0).tolist() == targets.tolist()


def test_large_hypergeometric():
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(draws) - 300_000) < 150 and 350 < np.std(draws) < 570
    assert sharding.hypergeometric(rng, 10**9, 0, 5) == 5 and sharding.hypergeometric(rng, 0, 10**9, 5) == 0
    many = sharding.split_counts(rng, np.array([10**9, 2 * 10**9, 10**9]), 4 * 10**9 - 7)
    assert int(many.sum()) == 4 * 10**9 - 7
