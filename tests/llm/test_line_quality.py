from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from markspan.llm import line_quality
from tests.llm.helpers import documents, frame, sentence

BLANK = r"[\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def lines_of(text):
    out = []
    for line in (text or "").split("\n"):
        line = re.sub(r"[0-9]+", "0", re.sub(BLANK, " ", line.lower()).strip(" "))
        if line:
            out.append((line, len(line.split(" "))))
    return out


def brute(rows, limit):
    carriers, first = defaultdict(set), {}
    for row, (i, text, _, source, _) in enumerate(rows):
        for line, _ in lines_of(text):
            carriers[source, line].add(row)
            first[source, line] = min(first.get((source, line), (True, 10**9, "")), (i is None, i or 0, text))
    out = []
    for i, text, _, source, _ in rows:
        n, chars, symbols, dup, repeat, failed = base(text)
        gone = sum(c for line, c in lines_of(text) if len(carriers[source, line]) > limit and first[source, line][2] != text)
        kept = not failed and (gone == 0 or (n - gone >= 10 and n - gone >= 0.25 * n))
        out.append((i, n, chars, symbols, dup, repeat, failed, kept, gone))
    return out


def judged(spark, rows, limit, clash=False):
    got = line_quality.line_frequency_verdicts(frame(spark, rows, clash), limit)
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words) for r in got.collect()]


@pytest.mark.parametrize(("limit", "clash"), [(2, False), (10, True)])
def test_equals_brute_force(spark, limit, clash):
    rows = documents(120)
    assert sorted(judged(spark, rows, limit, clash), key=repr) == sorted(brute(rows, limit), key=repr)


def test_depleted_documents_go_and_the_first_stays(spark):
    import random

    rng = random.Random(2)
    menu = "\n".join(sentence(rng, "en", 6) for _ in range(8))
    copied = "\n".join(sentence(rng, "en", 7) for _ in range(5))
    rows = [(i, f"{menu}\npage {chr(97 + i)}", "en", "site", 1) for i in range(15)]
    rows += [(50 + i, rows[0][1], "en", "site", 1) for i in range(3)]
    rows += [(100 + i, menu + "\n" + "\n".join(sentence(rng, "en", 9) for _ in range(9)), "en", "site", 1) for i in range(5)]
    rows += [(200 + i, copied, "en", "copies", 1) for i in range(40)]
    got = {r[0]: r for r in judged(spark, rows, 10)}
    assert [i for i in range(100) if i in got and got[i][7]] == [0, 50, 51, 52]
    assert all(got[100 + i][7] and got[100 + i][8] == 48 for i in range(5))
    assert all(got[200 + i][7] and got[200 + i][8] == 0 for i in range(40)), "copies of the first text keep its lines"


def test_copies_count_as_documents(spark):
    """Eleven rows in three texts: the line goes from all but the first text's rows."""
    import random

    rng = random.Random(4)
    line, texts = sentence(rng, "en", 9), [sentence(rng, "en", 30) for _ in range(3)]
    rows = [(i, f"{line}\n{texts[0 if i in (3, 9) else 1 + i % 2]}", "en", "site", 1) for i in range(11)]
    rows += [(i, f"{line}\n{texts[i % 3]}", "en", "small", 1) for i in range(20, 30)]
    got = judged(spark, rows, 10)
    assert sorted(got) == sorted(brute(rows, 10))
    assert {r[0] for r in got if r[8]} == {1, 5, 7} | {3, 9} and all(r[7] for r in got)


def test_equal_and_missing_ids_have_one_first_text(spark):
    import random

    rng = random.Random(5)
    line, texts = sentence(rng, "en", 9), [sentence(rng, "en", 30) for _ in range(4)]
    rows = [(None, f"{line}\n{t}", "en", None, 1) for t in texts for _ in range(4)] + [(7, f"{line}\n{t}", "en", "s", 1) for t in texts for _ in range(3)]
    got = judged(spark, rows, 10)
    assert Counter((r[0], r[8]) for r in got) == {(None, 0): 4, (None, 9): 12, (7, 0): 3, (7, 9): 9}


def test_repeated_windows(spark):
    words = [f"w{i}" for i in range(40)]
    cases = ["a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 9, "a " * 8, " ".join(words + words[5:16] + ["x"] * 3 + words[20:28])]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(cases)]
    assert {r[0]: r[5] for r in judged(spark, rows, 10)} == {i: base(t)[4] for i, t in enumerate(cases)}


def test_empty(spark):
    assert judged(spark, documents(3), 10) and frame(spark, documents(3)).limit(0).count() == 0
    assert line_quality.judge_documents(frame(spark, documents(3)).limit(0)).count() == 0


def test_cleaned_texts(spark):
    rows = [(i, "Same  line 1 of words\n\n" + f"own line {chr(97 + i)} of this document\nsame line 22 of WORDS", "en", "site", 1) for i in range(6)] + [(9, None, "en", "site", 1), (None, "same line 3 of words", "en", "site", 1)]
    got = {r.doc_id: (r.text, r.removed_words) for r in line_quality.cleaned_documents(frame(spark, rows), 5).collect()}
    assert got[0] == (rows[0][1], 0) and got[9] == (None, 0) and got[None] == ("", 5)
    assert got[3] == ("\nown line d of this document", 10)
