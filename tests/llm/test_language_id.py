from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from markspan.llm import language_id as L
from tests.llm.helpers import SYLLABLES, documents, frame, sentence


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    return L.train({lang: [sentence(rng, lang, 80) for _ in range(40)] for lang in SYLLABLES})


def test_probabilities_sum_to_one(model):
    """After any context the known symbols and the unknown one have probability 1 together, in each language."""
    ids = np.array([model.symbols[ord(c)] for c in " the of"])
    for n in range(4):
        context = ids[1 : 1 + n]
        total = np.zeros(3)
        for c in range(int(model.symbols.max()) + 1):
            total += np.exp(model._sum(np.append(context, c).astype(np.uint32), n))
        assert np.allclose(total, 1.0, atol=1e-6)


def plain_kneser_ney(texts, order=4):
    """log p(symbol | context) by the textbook recursion over dictionaries of strings."""
    from collections import Counter, defaultdict

    texts = ["".join(map(chr, L.normalise(t))) for t in texts]
    counts = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        before = defaultdict(set)
        for gram in counts[n + 1]:
            before[gram[1:]].add(gram[0])
        for t in texts:
            if len(t) >= n:
                before[t[:n]].add(None)
        counts[n] = Counter({g: len(b) for g, b in before.items()})
    discount = {}
    for n, table in counts.items():
        ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
    total, kinds = defaultdict(float), defaultdict(int)
    for n, table in counts.items():
        for gram, c in table.items():
            total[n, gram[:-1]] += c
            kinds[n, gram[:-1]] += 1

    def p(n, context, symbol, alphabet):
        if n == 0:
            return 1.0 / alphabet
        lower = p(n - 1, context[1:], symbol, alphabet)
        if not total[n, context]:
            return lower
        own = max(counts[n].get(context + symbol, 0) - discount[n], 0.0)
        return (own + discount[n] * kinds[n, context] * lower) / total[n, context]

    return p


def test_costs_equal_an_independent_kneser_ney():
    rng = random.Random(12)
    samples = {lang: [sentence(rng, lang, 40) for _ in range(4)] for lang in SYLLABLES}
    model = L.train(samples)
    alphabet = int(model.symbols.max()) + 1
    for lang, texts in samples.items():
        p, k = plain_kneser_ney(texts), model.languages.index(lang)
        for text in (sentence(rng, lang, 30), sentence(rng, "de", 30), "xyz qq"):
            codes = L.normalise(text)
            plain = "".join(chr(c) if c < len(model.symbols) and model.symbols[c] else "\0" for c in codes)
            want = -sum(np.log(p(min(4, i + 1), plain[max(0, i - 3) : i], plain[i], alphabet)) for i in range(len(plain)))
            assert model.costs(codes)[0][k] == pytest.approx(want, rel=1e-6)


def test_hash_array_finds_all():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    table = L.HashArray(keys, np.arange(len(keys), dtype=np.float32)[:, None])
    assert (table.values[table.find(keys), 0] == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1)) >= 0).sum() == np.isin(keys + np.uint64(1), keys).sum()


def test_pieces_of_a_long_text_add_up(model, monkeypatch):
    codes = L.normalise(sentence(random.Random(1), "de", 500))
    whole, n = model.costs(codes)
    monkeypatch.setattr(L, "_PIECE", 97)
    parts, m = model.costs(codes)
    assert n == m and np.allclose(whole, parts)


def test_rejects_what_no_model_knows(model):
    rng = random.Random(3)
    for lang in SYLLABLES:
        assert model.predict(sentence(rng, lang, 60))[::2] == (lang, False)
    noise = "".join(rng.choice("qxzjkvwpyQ ") for _ in range(600))
    assert model.predict(noise)[2]
    assert model.predict("日本語のテキストです" * 20)[2]


@pytest.mark.parametrize("clash", [False, True])
def test_contract(spark, clash):
    rows = documents(200)
    got = L.identify_documents(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, (t, _[0]))
    right = []
    for r in got:
        text, lang = texts[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0.0 <= r.score <= 1.0
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in SYLLABLES
            if r.held_out and r.doc_id < 200:
                right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.97


def test_prediction_ignores_labels(spark):
    rows = documents(100)
    model = L.train(L.training_sample(frame(spark, rows)))
    lied = frame(spark, [(i, t, "xx", "yy", 0) for i, t, *_ in rows])
    a = sorted(map(tuple, L.identify(frame(spark, rows), model, ["doc_id"]).collect()), key=repr)
    assert a == sorted(map(tuple, L.identify(lied, model, ["doc_id"]).collect()), key=repr)


def test_nothing_to_learn_from(spark):
    df = frame(spark, documents(10))
    assert L.identify_documents(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify_documents(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_learns_every_language(spark):
    """More than 200 languages, each of letters of its own."""
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice([*(chr(0xAC00 + 6 * k + j) for j in range(6)), " "]) for _ in range(60))
    rows = [(230 * i + k, text(k), f"x{k}", "s", 1) for k in range(230) for i in range(8 if k < 200 else 6)]
    model = L.train(L.training_sample(frame(spark, rows)))
    assert model.languages == sorted(f"x{k}" for k in range(230))
    assert [model.predict(text(k))[0] for k in range(230)] == [f"x{k}" for k in range(230)]


def test_learns_every_symbol():
    """Over 70,000 different letters: none is cut off, so texts of the last ones are told apart."""
    points = [c for c in range(0x3400, 0x323AF) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    assert len(points) > 70_000
    halves = {"low": points[:1000] + points[2000:], "high": points[1000:2000] + points[-40:]}
    model = L.train({k: ["".join(map(chr, v))] * 2 for k, v in halves.items()})
    assert int(model.symbols.max()) >= 70_000 and model.symbols[points[-1]] and model.symbols[points[-2]] != model.symbols[points[-1]]
    assert model.predict("".join(map(chr, points[-300:-100])))[0] == "low" and model.predict("".join(map(chr, points[1200:1400])))[0] == "high"


def test_one_id_on_many_rows_counts_once(spark):
    """20,000 rows of one doc_id, and some of others: a bounded number of texts comes, and no language is lost."""
    rng = random.Random(13)
    texts = [sentence(rng, "en", 20) for _ in range(5)]
    many = spark.range(20_000).selectExpr("3L as doc_id", f"element_at(array({', '.join(repr(t) for t in texts)}), cast(id % 5 as int) + 1) as text", "'en' as lang")
    few = spark.createDataFrame([(i, sentence(rng, "de", 20), "de") for i in (0, 1, 2, 4, 5, 6)] + [(3, sentence(rng, "fr", 20), "fr")], "doc_id long, text string, lang string")
    got = L.training_sample(many.union(few), 4)
    assert {k: len(v) for k, v in got.items()} == {"en": 1, "de": 4, "fr": 1} and got["en"][0] in texts
    assert {k: len(v) for k, v in L.training_sample(many.union(few), 4, 1).items()} == {"en": 1, "de": 1, "fr": 1}
    assert L.identify_documents(many).groupBy("lang_pred").count().collect()[0]["lang_pred"] == "en"


def test_asked_for_columns_may_clash(spark):
    model = L.train({"en": [sentence(random.Random(1), "en", 50)]})
    df = spark.createDataFrame([(1, "the thing", "x", 2.0)], "doc_id long, text string, lang_pred string, score double").selectExpr("*", "'y' as _text")
    got = L.identify(df, model, ["doc_id", "text", "lang_pred", "score", "_text"])
    assert got.columns == ["doc_id", "text", "_text", "lang_pred", "score", "rejected"] and got.first()[:4] == (1, "the thing", "y", "en")
