"""Mixing sources to target weights by pivotal dependent rounding of copies."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.llm.tables import BROADCAST_ROWS, discard, free_names, materialize, ship, with_row_id

WEIGHTS = (3.0, 1.0, 2.0)
CHUNK_ROWS = 20_000
FAN_IN = 64
#: Chunks of a level are dealt to so many partitions at most.
PARTITIONS = 1 << 15
#: A row that is repeated more often is dealt out in parts.
REPEATS = 10_000
MAX_SOURCES = 1_000_000
_EPS = 1e-9


def water_fill(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Targets in proportion to the weights, none above ``most`` times its size; the excess is reshared by weight."""
    target, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(float(total), most * sum(sizes))
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share >= most * sizes[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * share
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        free = [i for i in free if target[i] == 0.0]
    return target


def _coin(seed: int, *key) -> float:
    return xxhash.xxh64_intdigest(repr(key).encode(), seed) / 2.0**64


def pivot(items, seed: int, last: bool):
    """Pivotal rounding of (index, key, size, p) items in order.

    Two fractional probabilities trade mass, weighted by size so that the words
    expected stay the same, until one of them is 0 or 1; each keeps its
    expectation. Yields (index, 0 or 1) for the settled and returns the one
    fractional rest, or rounds it to the nearest if ``last``.
    """
    held = None
    for index, key, size, p in items:
        if p <= _EPS or p >= 1 - _EPS or size <= 0:
            yield index, float(round(p)), True
            continue
        if held is None:
            held = (index, key, size, p)
            continue
        hi, hk, hs, hp = held
        up, down = min((1 - hp) * hs, p * size), min(hp * hs, (1 - p) * size)
        move = up if _coin(seed, hk, key) * (up + down) < down else -down
        hp, p = hp + move / hs, p - move / size
        if hp <= _EPS or hp >= 1 - _EPS:
            yield hi, float(round(hp)), True
            held = (index, key, size, p)
            if p <= _EPS or p >= 1 - _EPS:
                yield index, float(round(p)), True
                held = None
        else:
            yield index, float(round(p)), True
            held = (hi, hk, hs, hp)
    if held is not None:
        index, _, _, p = held
        yield (index, float(p >= 0.5), True) if last else (index, p, False)


def mix(rows: DataFrame, seed: int = 11, weights=WEIGHTS, volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """Copies of each row of (doc_id, source, size): adds source_size, target and ``copies``.

    A source's target over its size is the expected number of copies of each of
    its rows; the whole part is certain and the fraction is rounded dependently.
    Equal rows are one item: of n of them the whole part of n fractions get one
    copy more for certain, and one fraction is left. Items are dealt into chunks
    by a hash of what they hold; a chunk settles all but one item per source, and
    the rests of FAN_IN chunks meet in the next level until one rest per source
    is left, rounded to the nearest. Larger items come first, so that the rests
    that travel are small; chunks and sources are dealt to tasks together. Random
    numbers hash the rows' contents, so reruns agree at any partitioning. The
    fraction of rows of size 0 is rounded to the nearest. Null ids and sources
    are values like others; an empty table gives an empty result.
    """
    plain = rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("size").cast("long"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("variant"), F.lit(0).cast("long").alias("rid"))
    return _each(_totals(plain, seed, weights, volume, most))


def _each(totals: DataFrame) -> DataFrame:
    """A row for each row that the items stand for."""
    copies = (F.col("whole") + (F.col("nth") < F.col("more")).cast("long")).alias("copies")
    return repeated(totals, "n", "nth").select("doc_id", "source", "size", "source_size", "target", copies)


def repeated(frame: DataFrame, times: str, nth: str) -> DataFrame:
    """Each row of ``frame`` (a written table, or narrow) ``times`` times, numbered from 0; no task makes more than REPEATS of one row
    before they are dealt out."""
    n = F.col(times)
    run = lambda lo, hi: F.explode(F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>")))
    zero = F.lit(0).cast("long")
    few = frame.where(n <= REPEATS).withColumn(nth, run(zero, n))
    many = frame.where(n > REPEATS)
    if many.isEmpty():
        return few
    (part,) = free_names(few, "part")
    parts = many.withColumn(part, run(zero, F.ceil(n / REPEATS))).repartition(F.col(part), n)
    return few.union(parts.withColumn(nth, run(F.col(part) * REPEATS, F.least(n, (F.col(part) + 1) * REPEATS))).drop(part))


def _totals(rows: DataFrame, seed: int, weights, volume: float, most: float) -> DataFrame:
    """One row per different row (doc_id, source, size, tie, variant): how many there are (n), the first row id, the copies that
    each has (whole) and how many of them have one more (more)."""
    spark = rows.sparkSession
    ship(spark)
    items = rows.groupBy("doc_id", "source", "size", "tie", "variant").agg(F.count("*").alias("n"), F.min("rid").alias("first"))
    table = materialize(items, "mix-items")
    by_source = table.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("items"))
    if by_source.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: they are mixture components, one row each on the driver")
    found = sorted(by_source.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [float(r["source_size"]) for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], volume * sum(sizes), most)
    total = sum(r["items"] for r in found)
    goals = spark.createDataFrame(
        [(r["source"], int(r["source_size"]), t, t / s if s else 0.0) for r, s, t in zip(found, sizes, targets, strict=True)],
        "source string, source_size long, target double, factor double",
    )
    chunks = max(1, -(-total // CHUNK_ROWS))
    g = goals.withColumnRenamed("source", "s")
    extra = F.col("n") * (F.col("factor") - F.col("whole"))
    sure = F.floor(extra + _EPS)
    frame = (
        table.join(g, table["source"].eqNullSafe(g["s"]), "left")
        .withColumn("whole", F.floor("factor").cast("long"))
        .withColumn("draw", F.xxhash64("doc_id", "size", "tie"))
        .select(
            "doc_id", "source", "size", "n", "first", "source_size", "target", "whole", sure.cast("long").alias("sure"),
            F.greatest(extra - sure, F.lit(0.0)).alias("p"), F.pmod("draw", F.lit(chunks)).cast("long").alias("chunk"), "draw", "variant",
        )
    )
    done = []
    while True:
        last = chunks == 1
        frame = materialize(_level(frame, chunks, len(found), seed, last), "mix-level")
        done.append(frame.where("settled"))
        if last:
            break
        chunks = -(-chunks // FAN_IN)
        frame = frame.where("NOT settled").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long")).drop("settled")
    discard(table)
    out = done[0]
    for level in done[1:]:
        out = out.union(level)
    return out.select("doc_id", "source", "size", "n", "first", "source_size", "target", "whole", (F.col("sure") + F.col("p").cast("long")).alias("more"))


_ROW = "doc_id long, source string, size long, n long, first long, source_size long, target double, whole long, sure long, p double, chunk long, draw long, variant long, settled boolean"
_NAMES = [part.split()[0] for part in _ROW.split(", ")]
_SOURCE, _SIZE, _P, _AT, _DRAW = (_NAMES.index(n) for n in ("source", "size", "p", "chunk", "draw"))
_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in map(str.split, _ROW.split(", "))])


def _level(frame: DataFrame, chunks: int, sources: int, seed: int, last: bool) -> DataFrame:
    """One level of the reduction tree: items of a chunk and source are paired in order of size, streaming."""

    def run(batches):
        carry: list = []  # the open row of the group at hand, one at most
        at = None
        for batch in batches:
            out = []
            rows = zip(*(column.to_pylist() for column in batch.columns), strict=True)
            for group, own in groupby(rows, key=lambda r: (r[_AT], r[_SOURCE])):
                if at is not None and at != group:
                    out += _settle(carry, seed, last)
                    carry = []
                at = group
                settled = _settle([*carry, *own], seed, False)
                carry = [r[:-1] for r in settled if not r[-1]]
                out += [r for r in settled if r[-1]]
            yield _batch(out)
        yield _batch(_settle(carry, seed, last))

    order = ["chunk", "source", F.desc("size"), "doc_id", "draw", "variant"]
    tasks = min(PARTITIONS, max(chunks, min(sources, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    dealt = frame.select(*_NAMES[:-1]).repartition(tasks, "chunk", "source").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _ROW)


def _settle(rows: list, seed: int, last: bool) -> list:
    items = ((i, (r[_DRAW], r[_AT]), r[_SIZE], r[_P]) for i, r in enumerate(rows))
    return [(*rows[i][:_P], p, *rows[i][_P + 1 :], done) for i, p, done in pivot(items, seed, last)]


def _batch(rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def word_count(text):
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _items(documents: DataFrame, *more) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *more)


def mix_documents(documents: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; null text has size 0, null source orders last.

    Rows with equal doc_id, source and text are equal here: which of them is
    taken more often does not show. Other columns are ignored.
    """
    zero = F.lit(0).cast("long")
    rows = _each(_totals(_items(documents, zero.alias("variant"), zero.alias("rid")), seed, WEIGHTS, 1.5, 2.0))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(documents: DataFrame, seed: int = 11) -> DataFrame:
    """The documents with each row repeated as often as the mix takes it; all input columns, whatever their names.

    Rows are written once with row ids, and copies are joined by these: a
    broadcast up to BROADCAST_ROWS rows, beyond that a sort-merge join. Of rows
    that are equal in all columns the first stands for all, so a group of copies
    is no hot key and reruns agree on the rows. (Columns that hold maps do not
    tell rows apart.)
    """
    rid, times, nth = free_names(documents, "_rid", "_times", "_nth")
    table = with_row_id(documents, "mix-rows", rid)
    told = [F.col(f"`{c}`") for c, kind in documents.dtypes if "map<" not in kind]
    totals = _totals(_items(table, F.xxhash64(*told).alias("variant"), F.col(rid).alias("rid")), seed, WEIGHTS, 1.5, 2.0)
    copies = materialize(totals.select(F.col("first").alias(rid), (F.col("n") * F.col("whole") + F.col("more")).alias(times)).where(F.col(times) > 0), "mix-copies")
    few = copies.count() <= BROADCAST_ROWS
    many = copies.where(F.col(times) > REPEATS)
    taken = lambda ids: table.join(F.broadcast(ids) if few else ids.hint("merge"), rid)
    once = taken(copies.where(F.col(times) <= REPEATS)).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    out = once.drop(rid, times, nth)
    return out if many.isEmpty() else out.union(repeated(taken(many), times, nth).drop(rid, times, nth))
