"""Bounded samples of labelled texts for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markspan.llm.tables import BROADCAST_ROWS, materialize

#: A longer text is sampled only after all others of its group.
LONG_TEXT_BYTES = 1 << 20


def bounded_sample(rows: DataFrame, group: str, most: int, most_bytes: int) -> DataFrame:
    """(group, doc_id, text): one whole text for each of up to ``most`` doc_ids of each group, by a hash of doc_id.

    ``rows`` has group, doc_id and text, none null. A doc_id with several rows
    in a group stands with its shortest text. Texts are taken while they hold
    ``most_bytes`` in all; the first is always taken, so no group with a text
    is without a sample. A test of the hash, by each group's number of different
    doc_ids (counted approximately), leaves some four times the ids wanted; only
    these are ranked, by their sizes, and the texts of the chosen are read in
    another scan, one per id before anything is shuffled.
    """
    ids = rows.groupBy(group).agg(F.approx_count_distinct("doc_id").alias("n"))
    every = materialize(ids.select(group, F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / (4 * most))).alias("every")), "sample-rates", small=True)
    sized = rows.join(_bounded(every), group).where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.col("every")) == 0)
    size, text_hash = F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_hash")
    least = sized.select(group, "doc_id", size, text_hash).groupBy(group, "doc_id", "size").agg(F.min("text_hash").alias("text_hash"))
    short = least.groupBy(group, "doc_id").agg(F.min("size").alias("size"))
    one = least.join(short, [group, "doc_id", "size"])
    order = Window.partitionBy(group).orderBy(F.col("size") > LONG_TEXT_BYTES, F.xxhash64("doc_id"), "doc_id")
    ranked = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    held = ranked.withColumn("held", F.sum("size").over(order)).where((F.col("rank") == 1) | (F.col("held") <= most_bytes))
    chosen = materialize(held.select(group, "doc_id", "text_hash"), "sample-ids", small=True)
    taken = rows.select(group, "doc_id", "text").join(_bounded(chosen), [group, "doc_id"]).where(F.xxhash64("text") == F.col("text_hash"))
    return taken.groupBy(group, "doc_id").agg(F.min("text").alias("text"))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")
