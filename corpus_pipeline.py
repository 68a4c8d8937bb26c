"""A five-stage corpus pipeline over documents, each stage one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspan.llm import bpe, language_id, line_quality, mixing, simhash
from markspan.llm.tables import keep_ids, materialize, scratch_scope, with_row_id

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models do not reject; texts without a letter are rejected."""
    model = language_id.train(language_id.training_sample(docs))
    return language_id.identify(docs, model, list(COLUMNS)).where("NOT rejected").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted of lines that their host repeats; each row by its own verdict.

    Only whole documents go: the texts of those that stay keep their lines (``line_quality.cleaned_documents`` removes lines).
    """
    rows = with_row_id(docs.select(*COLUMNS), "rows")
    rejected = materialize(line_quality.row_verdicts(rows).where("NOT kept").select("_rid"), "rejected")
    return keep_ids(rows, rejected, "_rid", "left_anti").select(*COLUMNS)


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one with the smallest doc_id, null last, and of those the first."""
    rows = with_row_id(docs.select(*COLUMNS), "rows")
    dropped = materialize(simhash.later_rows(rows), "dropped")
    return keep_ids(rows, dropped, "_rid", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row per row of the mixture."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", simhash_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_tokens", encode_tokens),
]

#: Model fitting, SimHash and random rounding have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each one's result is written and read again before the next.

    Rows are judged each, whatever their doc_id: rows without an id or with one
    that others have too stay or go by their own text. Of a class of near
    duplicates the row with the smallest doc_id stays, null last; among equal ids
    the first row in the table as it was written. Null and wordless texts have no
    language and go in the first stage. Columns other than those of documents are
    ignored, whatever their names. An empty table gives an empty result. Reruns
    over the same files agree.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
            made.remove(docs)
            made += [before] if before is not None else []
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
