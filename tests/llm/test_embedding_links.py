from __future__ import annotations

import math

import numpy as np
import pytest

from markspan.llm import embedding_links as E


def brute(rows, threshold=0.9):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((k, len(links[i]), least, k == least))
    return out


def vectors(n=150, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    x = [(i, (centres[rng.integers(20)] + rng.normal(size=dims) * rng.choice([0.05, 0.3])).astype("float32").tolist()) for i in range(n)]
    x += [(n + i, x[0][1]) for i in range(30)]  # copies
    x += [(n + 40, [2 * v for v in x[0][1]]), (n + 41, [-v for v in x[0][1]])]
    x += [(n + 50, None), (n + 51, []), (n + 52, [0.0] * dims), (n + 53, [float("nan")] * dims), (n + 54, [None] * dims), (n + 55, [float("inf")] + [0.0] * (dims - 1)), (None, x[0][1])]
    x += [(n + 60, [1.0, 2.0]), (n + 61, [1.0, 2.1]), (n + 62, [3.0]), (n + 62, [3.0])]
    return x


@pytest.mark.parametrize(("kind", "tile"), [("float", 4096), ("double", 16), ("float", 8)])
def test_equals_brute_force(spark, kind, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as n_links", "'x' as kept", "2 as id", "3 as v")
    got = [tuple(r) for r in E.near_links(df.repartition(3), tile_rows=tile).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_chain_is_one_component(spark):
    rows = [(i, [math.cos(i * 0.4), math.sin(i * 0.4)]) for i in range(15, -1, -1)]
    got = {r.vec_id: r for r in E.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {r.component_id for r in got.values()} == {0} and got[0].n_links >= 1


def test_empty_and_all_invalid(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    assert E.near_links(df.limit(0)).count() == 0
    got = E.near_links(df.where("embedding is null or size(embedding) = 0")).collect()
    assert sorted((r.n_links, r.kept) for r in got) == [(0, True), (0, True)]


@pytest.mark.parametrize("spread", [0.02, 0.5, 2.0])
def test_tiles_equal_all_pairs(spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 40))[rng.integers(3, size=300)] + spread * rng.normal(size=(300, 40))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    basis = E.pca_basis(unit)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)), strict=True)}
    assert set(zip(*E.tile_links(x, x, 0.9, True, basis), strict=True)) == want
    i, j = E.tile_links(x[:120], x[120:], 0.9, False, basis)
    assert set(zip(i, j + 120, strict=True)) == {(a, b) for a, b in want if a < 120 <= b}


def ties(dims=12):
    """A cosine of exactly 0.9 (90 over 10 * 10) between the first row and each other one, at several scales."""
    rows = [(0, [10.0] + [0.0] * (dims - 1))]
    for k in range(dims - 3):
        v = [9.0] + [0.0] * (dims - 1)
        v[1 + k], v[2 + k], v[3 + k] = 3.0, -3.0, 1.0
        rows.append((k + 1, [x * 2.0 ** (k - 4) for x in v]))
    return rows


@pytest.mark.parametrize("tile", [4096, 3])
def test_a_cosine_of_just_the_threshold_links(spark, tile):
    got = [tuple(r) for r in E.near_links(spark.createDataFrame(ties(), "vec_id long, embedding array<double>"), tile_rows=tile).collect()]
    assert sorted(got) == sorted(brute(ties())) and sorted(got)[0][1] == 9


def test_ties_among_many_integer_vectors():
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, size=(400, 6)).astype(float)
    x = x[np.abs(x).sum(axis=1) > 0]
    norm = np.sqrt((x * x).sum(axis=1))
    for threshold in (0.9, 0.8, 0.5, 1.0):
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu((x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold, 1)), strict=True)}
        assert set(zip(*E.tile_links(x, x, threshold, True, E.pca_basis(x / norm[:, None])), strict=True)) == want


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.1e-300]), (3, [-1e300, 1e300]), (4, [5e-324, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_one_id_on_different_vectors(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (5, [0.0, 2.0]), (9, [3.0, 0.1]), (9, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in E.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted(brute(rows))


def test_clusters_compare_few_pairs_of_tiles(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("id as key", "id", "v", "1L as n")
    found, tiles = E._compare(df, 16, len(rows), 0.9, 32, 8)
    compared = found.where("kind = 2").agg({"a": "sum"}).first()[0]
    assert tiles >= 40 and compared < 0.25 * tiles * (tiles + 1) / 2
    got = [tuple(r) for r in E.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile_rows=32, group_tiles=8).collect()]
    assert sorted(got) == sorted(brute(rows))
