from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from markspan.llm import packing
from tests.llm.helpers import documents, frame


def plain_best_fit(sizes, length):
    rows, left = [], []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(c, k) for k, c in enumerate(left) if c >= sizes[item]]
        if not fit:
            rows.append([item])
            left.append(length - sizes[item])
        else:
            least = min(c for c, _ in fit)
            k = next(k for c, k in fit if c == least)
            rows[k].append(item)
            left[k] -= sizes[item]
    return rows


@pytest.mark.parametrize("length", [1, 2, 7, 64, 100])
def test_as_full_as_plain_best_fit(length):
    rng = random.Random(length)
    for _ in range(30):
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        got, want = packing.best_fit_decreasing(sizes, length), plain_best_fit(sizes, length)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        fill = lambda rows: sorted(sum(sizes[i] for i in r) for r in rows)
        assert fill(got) == fill(want) and all(x <= length for x in fill(got))


@pytest.mark.parametrize("chunk", [50, 1 << 21])
def test_lossless(spark, chunk):
    rows = documents(40)
    with open(packing.default_ranks(), "rb") as file:
        encode = packing._encoding(file.read()).encode_ordinary
    want = Counter((i, tuple([*encode(t or ""), packing.END_ID])) for i, t, *_ in rows)
    packs = packing.pack_documents(frame(spark, rows, True), length=32, chunk_tokens=chunk).collect()
    assert len({p.pack_id for p in packs}) == len(packs)
    parts = defaultdict(list)
    for p in packs:
        ids, positions = np.frombuffer(p.ids, "<u4"), np.frombuffer(p.positions, "<u4")
        assert len(ids) == len(positions) == 32 and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens <= 32
        assert (ids[p.n_tokens :] == packing.END_ID).all() and not positions[p.n_tokens :].any()
        for s, a, b in zip(p.segments, p.cu_seqlens, p.cu_seqlens[1:], strict=False):
            assert b - a == s.length and positions[a:b].tolist() == list(range(s.length))
            parts[s.doc_id].append((s.start, tuple(ids[a:b].tolist())))
    got = Counter()
    for i, found in parts.items():
        found.sort()
        copies = sum(start == 0 for start, _ in found)
        starts = sorted({start for start, _ in found})
        whole = tuple(x for start in starts for x in next(ids for s, ids in found if s == start))
        assert len(found) == copies * len(starts)
        got[i, whole] += copies
    assert got == want


def test_empty(spark):
    assert packing.packed_digest(frame(spark, documents(3)).limit(0)).count() == 0
    row = packing.packed_digest(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)).first()
    assert (row.n_tokens, sorted(row.doc_ids), row.starts, row.cu_seqlens) == (2, [1, 2], [0, 0], [0, 1, 2])
