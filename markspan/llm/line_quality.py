"""Quality rules with cross-document line frequency. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.tables import BROADCAST_ROWS, discard, materialize, with_row_id

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text.

    A window is the 64-bit hash of its words' hashes. Only texts with a repeated
    window sort their (hash, position) pairs; the covered words are then summed
    over the repeated windows' positions in order.
    """
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  binds a value once
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(w):
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s):
            same = lambda x, i, step: F.coalesce(F.get(s, i + step)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

        def total(p):
            return F.aggregate(
                p,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
            )["n"]

        return let(let(pairs, repeated), total)

    count = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) > WINDOW, let(hashes, lambda h: let(windows(h), count))).otherwise(F.lit(0).cast("long"))


def normalised_line(line: Column) -> Column:
    """Letter case, kinds of blanks and digits do not tell lines apart; empty for a line without a word."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), BLANK, " ")), r"\d+", "0")


def _lines(text: Column) -> Column:
    """Hash and number of words of each normalised line with a word."""
    plain = F.filter(F.transform(F.split(text, "\n"), normalised_line), lambda x: x != "")
    return F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def document_statistics(documents: DataFrame, *more: str) -> DataFrame:
    """One row per document (row): base metrics, and ``lines`` array<struct<h,n>> of its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select("doc_id", "source", *more, text.alias("text"), words_of(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"))
    return split.select(
        "doc_id",
        "source",
        *more,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _lines(F.col("text")).alias("lines"),
        F.xxhash64("text").alias("text_hash"),
    )


def common_lines(stats: DataFrame, max_documents: int) -> DataFrame:
    """(host, h, least_id, least_hash): normalised lines in more than ``max_documents`` documents of a host, with the smallest
    doc_id and the smallest text hash of these.

    A document counts once per line, however often it has it. Counts are summed
    before they are shuffled, so a line of a third of all rows is no hot spot.
    """
    once = stats.select(_host().alias("host"), "doc_id", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counted = once.groupBy("host", "h").agg(F.count("*").alias("documents"), F.min("doc_id").alias("least_id"), F.min("text_hash").alias("least_hash"))
    return materialize(counted.where(F.col("documents") > max_documents).drop("documents"), "common-lines", small=True)


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _sized(table: DataFrame) -> DataFrame:
    """A written table for a join: broadcast up to BROADCAST_ROWS, which are counted."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def _removals(stats: DataFrame, max_documents: int) -> DataFrame:
    """(_rid, h, n): the lines to remove, one row per occurrence.

    Only occurrences of common lines are looked at for the text that keeps them.
    """
    common = common_lines(stats, max_documents)
    flat = stats.select(_host().alias("host"), "_rid", "doc_id", "text_hash", F.inline("lines"))
    held = materialize(flat.join(_sized(common), ["host", "h"]), "common-held")
    first = held.where(F.col("doc_id").eqNullSafe(F.col("least_id"))).groupBy("host", "h").agg(F.min("text_hash").alias("first"))
    keeper = materialize(first, "line-keepers", small=True)
    discard(common)
    return held.join(_sized(keeper), ["host", "h"]).where("text_hash <> first").select("_rid", "h", "n")


def _verdicts(stats: DataFrame, removed: DataFrame, min_words: int, min_share: float) -> DataFrame:
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (
        stats.drop("lines", "text_hash")
        .join(removed, "_rid", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ((F.col("removed_words") == 0) | ((left >= min_words) & (left >= min_share * F.col("n_words")))))
    )


def line_frequency_verdicts(documents: DataFrame, max_documents: int = 10, min_words: int = 10, min_share: float = 0.25) -> DataFrame:
    """One row per document: base metrics, base_failed, words removed, and kept.

    A normalised line that occurs in more than ``max_documents`` documents of a
    host (the ``source`` column) is removed from them all but the first, the one
    with the smallest doc_id, so that no passage vanishes from the host. A
    document left with under ``min_words`` words or under ``min_share`` of its
    words is rejected, as is one that fails the base rules.

    Each row counts as a document, copies too. A rule of its own protects copies:
    rows whose text equals the first document's keep the line as well, so a group
    of copies is judged alike and left to near-duplicate removal. Every row is
    judged, whatever its doc_id; null hosts form one host; a null doc_id orders
    last, and of equal doc_ids the smaller hash of the text comes first. Null text
    has no words and fails. An empty table gives an empty result; other columns
    are ignored.
    """
    stats = materialize(document_statistics(documents).withColumn("_rid", F.monotonically_increasing_id()), "line-stats")
    return _judged(stats, max_documents, min_words, min_share).drop("_rid")


def row_verdicts(documents: DataFrame, max_documents: int = 10, min_words: int = 10, min_share: float = 0.25) -> DataFrame:
    """``line_frequency_verdicts`` of documents that have row ids, with these (_rid)."""
    return _judged(materialize(document_statistics(documents, "_rid"), "line-stats"), max_documents, min_words, min_share)


def _judged(stats: DataFrame, max_documents: int, min_words: int, min_share: float) -> DataFrame:
    removed = _removals(stats, max_documents).groupBy("_rid").agg(F.sum("n").cast("long").alias("removed_words"))
    return _verdicts(stats, removed, min_words, min_share)


def cleaned_documents(documents: DataFrame, max_documents: int = 10, min_words: int = 10, min_share: float = 0.25) -> DataFrame:
    """(doc_id, source, text, kept, removed_words): the texts without the lines that ``line_frequency_verdicts`` removes.

    Texts are written once with a row number; lines to remove are gathered per
    document, whose own number of lines bounds them, and joined to the texts.
    """
    table = with_row_id(documents.select("doc_id", "source", "text"), "texts")
    stats = materialize(document_statistics(table, "_rid"), "line-stats")
    removed = _removals(stats, max_documents).groupBy("_rid").agg(F.sum("n").cast("long").alias("removed_words"), F.collect_set("h").alias("gone"))
    verdicts = materialize(_verdicts(stats, removed, min_words, min_share).select("_rid", "kept", "removed_words", "gone"), "line-verdicts")
    stay = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normalised_line(x))) | (normalised_line(x) == ""))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return table.join(verdicts.hint("merge"), "_rid").select("doc_id", "source", text.alias("text"), "kept", "removed_words")


def judge_documents(documents: DataFrame) -> DataFrame:
    """The columns of ``line_frequency_verdicts`` that its query returns, one row per row; odd rows as there."""
    return line_frequency_verdicts(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )
