from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASH = "shard int, slot long, kept boolean, host string, component_id long, fp long, size long, words string, lines string, copies long, score double, ids string, h long, n long"

SYLLABLES = {"en": "the of and ing tion er th st ent re".split(), "fr": "é eau ou ment que è aux les tre çon".split(), "de": "sch ung ein ich ver ß ä der lich auf".split()}


def sentence(rng: random.Random, lang: str, words: int) -> str:
    out = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(out) + "."


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    """Prose in three languages with copies, near copies, shared lines, and every odd case."""
    rng = random.Random(seed)
    rows = []
    shared = sentence(rng, "en", 12)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(sentence(rng, lang, rng.randint(5, 60)) for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            text += "\n" + shared
        rows.append((i, text, lang, f"src{rng.choice([0, 0, 0, 1, 2])}", len(text)))
    base = rows[1][1]
    rows += [
        (n, base, "en", "src0", 1),
        (n + 1, base + " more", "en", "src0", 1),
        (n + 2, base, "en", None, 1),
        (n + 3, None, None, None, None),
        (n + 4, "", "en", "src0", 0),
        (n + 5, " \t\n\v\f\r ", "en", "src1", 6),
        (n + 6, "1234 ### 99 <|endoftext|> $$", None, "src1", 9),
        (n + 7, "word " * 30_000, "en", "src2", 150_000),
        (n + 8, "one two", "en", "src2", 7),
        (n + 9, "naïve café  　 日本語 𝔘𝔫𝔦 é   it's we'll 12a", "fr", "é", 9),
        (n + 9, "naïve café  　 日本語 𝔘𝔫𝔦 é   it's we'll 12a", "fr", "é", 9),
        (n + 10, "a b c d e f g h " * 6, "en", "src1", 96),
        (None, "text without an id that has some words in it", "en", "src0", 1),
    ]
    return rows


def frame(spark, rows, clash: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for part in CLASH.split(", "):
            name, kind = part.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3)
