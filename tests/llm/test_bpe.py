from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from markspan.llm import bpe
from tests.llm.helpers import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as file:
        return bpe.ByteBpe(file.read())


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_odd_texts(ours, theirs):
    rng = random.Random(4)
    alphabet = list("aAbBzZ09 \t\n\r\f\v.,'#<|>éßñÇ日本語한글😀 　​\x85\x1c\x1f  İıſK①²٣़") + ["<|endoftext|>", "'s", "'ll", "  ", "\n\n", "​", "the "]
    texts = ["", " ", "  a", "a  ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "I'LL it's", "x" * 5000, "\n" * 300, " " * 999]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        got = ours.encode(text)
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids(got) == want, repr(text)
        assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False) == text


def test_stale_entries_and_long_pieces(ours, theirs):
    for piece in ("aaaaaaaaaaaa", "ababababab", "mississippi" * 50, "thethethethe"):
        assert ids(ours.encode(piece)) == theirs.encode(piece, add_special_tokens=False).ids


def test_cache_is_bounded(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(500))
    assert ids(ours.encode(text)) == theirs.encode(text, add_special_tokens=False).ids
    ours.cache.clear()
    ours.encode(text)
    assert len(ours.cache) <= 10 and len(ours.cache.old) <= 10


@pytest.mark.parametrize("clash", [False, True])
def test_query(spark, theirs, clash):
    rows = documents(40)
    want = Counter()
    for i, text, *_ in rows:
        e = theirs.encode(text or "", add_special_tokens=False).ids
        want[i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_documents(frame(spark, rows, clash)).collect())) == want
    assert bpe.encode_documents(frame(spark, rows).limit(0)).count() == 0
    assert ids(bpe.encode_documents(frame(spark, rows[:1]), with_ids=True).first().ids) == theirs.encode(rows[0][1], add_special_tokens=False).ids
