from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from markspan.llm import language_id, mixing
from tests.llm.helpers import SCHEMA, documents, frame, sentence
from tests.llm.test_line_quality import brute as quality
from tests.llm.test_simhash import classes, plain_fingerprint


def test_equals_stage_by_stage_brute_force(spark, tmp_path):
    rows = documents(150)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.train(language_id.training_sample(docs))
    kept = [r for r in rows if not model.predict(r[1])[2]]
    kept = [r for r, v in zip(kept, quality(kept, 10), strict=True) if v[7]]
    first = {}
    for r, g in zip(kept, classes([plain_fingerprint(r[1]) for r in kept]), strict=True):
        first[g] = min(first.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))  # rows of equal ids are equal here
    once = list(first.values())
    mixed = mixing.mix_documents(spark.createDataFrame(once, SCHEMA))
    copies = {r.doc_id: r.taken // max(1, r["size"]) for r in mixed.collect()}
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in once:
        e = encoder.encode(text or "", add_special_tokens=False).ids
        if copies[i]:
            want[i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += copies[i]
    assert got == want


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table, extra columns of any name, a null id, and a second run."""
    rows = documents(40) + [(None, documents(41)[40][1], "en", "src1", 5)]
    frame(spark, rows, True).selectExpr("*", "1 as _rid", "2 as _size", "'x' as lang_pred", "0.5 as _times", "3 as _text").write.parquet(f"{tmp_path}/wide/documents.parquet")
    spark.read.parquet(f"{tmp_path}/wide/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/plain/documents.parquet")
    runs = [Counter(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())) for name in ("wide", "plain", "plain")]
    assert runs[0] == runs[1] == runs[2] and sum(runs[0].values()) > 20 and any(r[0] is None for r in runs[0])
    spark.read.parquet(f"{tmp_path}/plain/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_run_keeps_only_the_last_stage_s_input(spark, tmp_path):
    import os

    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/markspan"
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    frame(spark, documents(20)).write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [x.split("-", 1)[1] for x in set(os.listdir(scratch)) - before] == ["mix_sources"]


def test_stages_return_documents(spark, tmp_path):
    spark.createDataFrame(documents(20), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_without_or_with_repeated_ids_are_judged_each(spark):
    rng = random.Random(7)
    clean = [sentence(rng, "en", 60) for _ in range(5)]
    rows = [(None, "short", "en", "s", 1), (None, clean[0], "en", "s", 1), (None, clean[0], "en", "s", 1), (1, clean[0], "en", "s", 1)]
    rows += [(None, clean[1], "en", "s", 1), (None, clean[1], "en", "s", 1), (2, clean[2], "en", "s", 1), (2, "short", "en", "s", 1)]
    rows += [(3, clean[3], "en", "s", 1), (3, clean[0], "en", "s", 1), (3, clean[4], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fine = corpus_pipeline.quality_rules(spark, docs, "")
    assert Counter(map(tuple, fine.collect())) == Counter(r for r in rows if r[1] != "short")
    once = corpus_pipeline.simhash_near_duplicates(spark, fine, "")
    assert Counter((r.doc_id, r.text) for r in once.collect()) == Counter([(1, clean[0]), (None, clean[1]), (2, clean[2]), (3, clean[3]), (3, clean[4])])


def test_rows_without_ids_share_the_copies_of_the_mixture(spark):
    rng = random.Random(8)
    rows = [(None, sentence(rng, "en", 30), "en", source, 1) for source in ("a", "b", "c") for _ in range(20)]
    taken = Counter(r.text for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    for source in ("a", "b", "c"):
        times = [taken[text] for _, text, _, s, _ in rows if s == source]
        assert max(times) - min(times) <= 1
