"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markspan.llm.tables import free_names, ship, utf8_size, with_row_id

BLOCK_ROWS = 65_536
_NUMPY_LIMIT = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good items among ``draws`` without replacement.

    Beyond numpy's limit by the inverse of the distribution function, summed in
    double precision over 14 standard deviations either way; what lies outside
    is below 1e-40, far under the step of a double-precision uniform number.
    """
    if good + bad <= _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    mean = draws * good / (good + bad)
    sd = (mean * (bad / (good + bad)) * ((good + bad - draws) / (good + bad - 1))) ** 0.5
    a, b = max(low, int(mean - 14 * sd) - 30), min(high, int(mean + 14 * sd) + 30)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split_counts(rng: np.random.Generator, targets: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``draws`` rows go to each target."""
    total = int(targets.sum())
    if total <= _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(targets, draws, method="marginals") if total else targets * 0
    out = np.zeros_like(targets)
    for i, n in enumerate(targets.tolist()):
        total -= n
        out[i] = hypergeometric(rng, n, total, draws) if draws else 0
        draws -= int(out[i])
    return out


def matrix_row(sizes: np.ndarray, targets: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix, without the other rows.

    The matrix with row sums ``sizes`` and column sums ``targets`` is drawn by
    halving the range of partitions; each node of that tree has its own seed, so
    every task finds its row on one path and no one holds the whole matrix.
    """
    lo, hi, left = 0, len(sizes), targets
    ends = np.concatenate([[0], np.cumsum(sizes)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = split_counts(np.random.default_rng([seed, lo, hi]), left, int(ends[mid] - ends[lo]))
        lo, hi, left = (lo, mid, first) if part < mid else (mid, hi, left - first)
    return left


def shard_targets(rows: int, n_shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of each block; shard sizes differ by one at most."""
    per = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    shard, first, size = [], [], []
    for s, n in enumerate(per):
        k = max(1, -(-n // block_rows))
        cut = [n * i // k for i in range(k + 1)]
        for a, b in zip(cut, cut[1:], strict=False):
            shard.append(s)
            first.append(a)
            size.append(b - a)
    return np.array(shard), np.array(first, dtype=np.int64), np.array(size, dtype=np.int64)


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in its shard): a uniform random permutation.

    1. The rows are written once with their partition and index, so retries see the same rows.
    2. The number of rows of each partition fixes the row sums and the shard
       sizes (at most one apart) the column sums of a hypergeometric
       communication matrix. A shard is cut into blocks of exact size, so no
       task orders a whole shard.
    3. Each partition permutes its labels locally, each row is sent to its block,
       and a block permutes its rows again by random keys.

    The sizes of partitions and of blocks (24 bytes for every ``block_rows``
    rows) are all that the driver holds. Nulls, long texts and extra columns of
    any name pass through; repeated rows are rows of their own; an empty table
    gives an empty result. Columns of the input named ``shard`` or ``slot`` are
    replaced.
    """
    spark = df.sparkSession
    ship(spark)
    own = df.drop("shard", "slot")
    rid, start, chunk, order, place = free_names(own, "_rid", "_first", "_block", "_key", "_place")
    table = with_row_id(own, "shard-rows", rid)
    counts = dict(table.groupBy(F.shiftrightunsigned(rid, 33).cast("int").alias("p")).count().collect())
    parts = np.array(sorted(counts), dtype=np.int64)
    sizes = np.array([counts[p] for p in parts.tolist()], dtype=np.int64)
    shard, first, target = shard_targets(int(sizes.sum()), n_shards, block_rows)
    plan = spark.sparkContext.broadcast((parts, sizes, shard, first, target))

    def deal(batches):
        parts, sizes, shard, first, target = plan.value
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            part, index = rows >> 33, rows & ((1 << 33) - 1)
            block, key = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
            for p in np.unique(part).tolist():
                if p not in known:
                    at = int(np.searchsorted(parts, p))
                    rng = np.random.default_rng([seed, 1 << 40, p])
                    labels = np.repeat(np.arange(len(target), dtype=np.int32), matrix_row(sizes, target, at, seed))
                    known.clear()
                    known[p] = rng.permutation(labels), rng.integers(0, 2**63 - 1, len(labels))
                here = part == p
                block[here], key[here] = (x[index[here]] for x in known[p])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard[block].astype(np.int32)), pa.array(first[block]), pa.array(block.astype(np.int32)), pa.array(key)],
                names=[*batch.schema.names, "shard", start, chunk, order],
            )

    fields = [T.StructField("shard", T.IntegerType()), T.StructField(start, T.LongType()), T.StructField(chunk, T.IntegerType()), T.StructField(order, T.LongType())]
    dealt = table.mapInArrow(deal, T.StructType([*table.schema.fields, *fields]))
    placed = dealt.withColumn(place, F.row_number().over(Window.partitionBy(chunk).orderBy(order, rid)))
    return placed.withColumn("slot", F.col(start) + F.col(place) - 1).drop(start, chunk, order, rid, place)


def shard_documents(documents: DataFrame, n_shards: int = 24) -> DataFrame:
    """The digest of the sharded documents: law ``rows`` (shard sizes at most one apart).

    Null text has size 8 and the checksum of an empty one; other columns are
    ignored, odd rows are dealt as ``shuffle_into_shards`` says.
    """
    digest = documents.select("doc_id", (utf8_size(F.col("text")) + 8).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(digest, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
