from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from markspan.llm import simhash
from markspan.llm.components import connected_components
from tests.llm.helpers import documents, frame


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """Smallest index reachable over links of two or fewer bits."""
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("clash", [False, True])
def test_equals_brute_force(spark, clash):
    rows = documents(80)
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    groups = classes(prints)
    least = {g: min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None) for g in set(groups)}
    want = sorted(((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups, strict=True)), key=repr)
    got = sorted((tuple(r) for r in simhash.fingerprint_classes(frame(spark, rows, clash)).collect()), key=repr)
    assert got == want


def test_links_over_crafted_fingerprints(spark):
    """Chains of one- and two-bit steps, a crowded ball, and pairs just too far apart."""
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(30):
            values.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                at ^= 1 << b
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)} | {0, 1, 1 << 63, (1 << 64) - 1}
    values = sorted(values)
    groups = classes(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    links = simhash.near_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"))
    label = {r.node: r.component for r in connected_components(links).collect()}
    got = [label.get(v, v) for v in signed]
    assert len(set(zip(groups, got, strict=True))) == len(set(groups)) == len(set(got))


@pytest.mark.parametrize(("posting", "positions"), [(2, 1), (5, 2), (40, 3), (3, 6)])
def test_postings_of_any_size_and_split_give_the_same_classes(spark, monkeypatch, posting, positions):
    """Crowded postings are split position by position, down to those of six."""
    monkeypatch.setattr(simhash, "POSTING", posting)
    monkeypatch.setattr(simhash, "first_positions", lambda n: positions)
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(60)}
    for at in list(values)[:6]:
        values |= {at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.randrange(3) << rng.randrange(60)) for _ in range(40)}
    values = sorted(values)
    groups = classes(values)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long").repartition(3)
    label = {r.node: r.component for r in connected_components(simhash.near_fingerprints(frame)).collect()}
    got = [label.get(int(np.uint64(v).astype(np.int64)), v) for v in values]
    assert len(set(zip(groups, got, strict=True))) == len(set(groups)) == len(set(got))


def test_a_posting_over_several_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "POSTING", 4)
    keys = [(3, 7, i) for i in range(2)] + [(3, 9, 100 + i) for i in range(11)] + [(5, 9, 1 << (i + 8)) for i in range(4)] + [(63, 0, 1 << i) for i in range(9)]
    for size in (1, 2, 3, 5, 30):
        batches = [pa.RecordBatch.from_arrays([pa.array([k[c] for k in keys[at : at + size]], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["chosen", "shared", "fp"]) for at in range(0, len(keys), size)]
        rows = [r for out in simhash._tally(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        assert sorted(r[1] for r in rows if r[0] == 3) == list(range(100, 111)) and {r[0] for r in rows} == {0, 3}
        links = {(a, b) for c, a, b in rows if c == 0}
        assert {a for a, b in links} == {1, *(1 << (i + 8) for i in range(1, 4)), *(1 << i for i in range(1, 9))}


def test_neighbours_equal_tally():
    rng = np.random.default_rng(2)
    members = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64)) | np.uint64(0xABCDEF0000000000)
    want = {(a, b) for a in range(len(members)) for b in range(a) if int(members[a] ^ members[b]).bit_count() <= 2}
    for found in (simhash.neighbour_links(members), simhash.tally_links(members)):
        assert {(max(a, b), min(a, b)) for a, b in zip(*(x.tolist() for x in found), strict=True)} == want


def test_components_by_rounds_equal_one_task(spark, monkeypatch):
    from markspan.llm import components

    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 - i, 1001 - i) for i in range(40)], "src long, dst long")
    want = sorted(map(tuple, connected_components(edges).collect()))
    monkeypatch.setattr(components, "TASK_EDGES", 0)
    assert sorted(map(tuple, connected_components(edges).collect())) == want


def test_empty(spark):
    assert simhash.fingerprint_classes(frame(spark, documents(3)).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 400)] + [(5, 5), (7, 3), (3, 7), (3, 7)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(200)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: c for x, c in label.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
