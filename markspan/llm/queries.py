"""The thin queries of the ten operators over their tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markspan.llm import bpe, embedding_links, language_id, line_quality, mixing, ordinal_quality, packing, sharding, simhash, url_filter
from markspan.llm.oracles import ORACLES
from markspan.llm.tables import read_table


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op2_link_trust_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op3_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge_documents(read_table(spark, sf_dir, "documents"))


def op4_pca_tiled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_links(read_table(spark, sf_dir, "embeddings"))


def op5_pivotal_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(read_table(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.grade_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_classes(read_table(spark, sf_dir, "documents"))


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_hypergeometric_shards,
            op2_link_trust_urls,
            op3_line_frequency_quality,
            op4_pca_tiled_links,
            op5_pivotal_mixture,
            op6_best_fit_packing,
            op7_ordinal_quality,
            op8_simhash_near_duplicates,
            op9_kneser_ney_language,
            op10_byte_bpe,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
