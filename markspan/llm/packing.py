"""Packing token ids into fixed-length rows: best-fit-decreasing with a segment tree over remaining capacity."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.llm.tables import ship

LENGTH = 2_048
CHUNK_TOKENS = 1 << 21
END_ID = 50_256


class CapacityTree:
    """Segment tree over remaining capacities 0..most; a leaf holds the open rows with that capacity."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take_best(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the smallest capacity >= need, taken out; None if none fits."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item indexes, each row's sizes at most ``length`` together; larger items first, each into the fullest row that takes it."""
    tree, rows = CapacityTree(length), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_best(sizes[item])
        if found is None:
            rows.append([item])
            capacity, row = length, len(rows) - 1
        else:
            capacity, row = found
            rows[row].append(item)
        if capacity - sizes[item]:
            tree.add(capacity - sizes[item], row)
    return rows


_ENCODINGS: dict[bytes, object] = {}


def _encoding(source: bytes):
    import public_tokenizers
    import tiktoken

    key = hashlib.sha256(source).digest()
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32())])
SCHEMA = "n_tokens int, ids binary, cu_seqlens array<int>, positions binary, segments array<struct<doc_id:long,start:long,length:int>>"


def pack_documents(documents: DataFrame, length: int = LENGTH, end_id: int = END_ID, ranks: str | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Packed rows (pack_id, n_tokens, ids, cu_seqlens, positions, segments) of the whole texts.

    A text is encoded, ends with ``end_id`` and is cut into segments of
    ``length`` ids and a rest, without loss; segments of about ``chunk_tokens``
    ids are packed at a time, so memory is bounded and nothing is shuffled. ``ids``
    holds ``length`` little-endian unsigned 32-bit integers (unused places are
    ``end_id``), ``positions`` as many that restart from 0 with each segment and
    stay 0 where unused; ``cu_seqlens`` are the cumulative segment lengths from
    0; ``segments`` name each segment's document and its start in that document.

    Null and empty texts are one ``end_id``. Repeated rows are packed again, ties
    keep the table's order, other columns are ignored, an empty table gives no
    rows. pack_id is a partition's number << 33 plus an index.
    """
    spark = documents.sparkSession
    ship(spark)
    with open(ranks or default_ranks(), "rb") as file:
        source = spark.sparkContext.broadcast(file.read())

    def pack(owners: list, pieces: list) -> pa.RecordBatch:
        counts, ids, ends, places, segments = [], [], [], [], []
        for row in best_fit_decreasing([len(p) for p in pieces], length):
            sizes = [len(pieces[i]) for i in row]
            used = sum(sizes)
            values = np.full(length, end_id, "<u4")
            values[:used] = np.concatenate([pieces[i] for i in row])
            positions = np.zeros(length, "<u4")
            positions[:used] = np.concatenate([np.arange(n, dtype="<u4") for n in sizes])
            counts.append(used)
            ids.append(values.tobytes())
            places.append(positions.tobytes())
            ends.append(np.concatenate([[0], np.cumsum(sizes)]).tolist())
            segments.append([{"doc_id": owners[i][0], "start": owners[i][1], "length": n} for i, n in zip(row, sizes, strict=True)])
        return pa.RecordBatch.from_arrays(
            [pa.array(counts, pa.int32()), pa.array(ids, pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array(places, pa.binary()), pa.array(segments, pa.list_(_SEGMENT))],
            names=["n_tokens", "ids", "cu_seqlens", "positions", "segments"],
        )

    def run(batches):
        encoding = _encoding(source.value)
        owners, pieces, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.array([*encoding.encode_ordinary(text.as_py() or ""), end_id], dtype="<u4")
                for start in range(0, len(tokens), length):
                    pieces.append(tokens[start : start + length])
                    owners.append((doc_id.as_py(), start))
                    held += len(pieces[-1])
                    if held >= chunk_tokens:
                        yield pack(owners, pieces)
                        owners, pieces, held = [], [], 0
        yield pack(owners, pieces)

    packed = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return packed.withColumn("pack_id", F.monotonically_increasing_id())


def packed_digest(documents: DataFrame) -> DataFrame:
    """Per packed row: its documents, starts, lengths, number of ids, and digests of the id and position rows."""
    return pack_documents(documents).select(
        "pack_id",
        "n_tokens",
        F.size("segments").alias("n_segments"),
        F.transform("segments", lambda s: s["doc_id"]).alias("doc_ids"),
        F.transform("segments", lambda s: s["start"]).alias("starts"),
        "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.crc32("positions").alias("positions_crc32"),
    )
