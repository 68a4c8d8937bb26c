"""SimHash near-duplicates through an inverted index of byte positions with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.components import connected_components, union
from markspan.llm.tables import materialize, ship

BYTES = 8
#: Two bits differ in two bytes at most, so six of the eight positional bytes are shared.
MAX_BITS = 2
LEAST_SHARED = BYTES - MAX_BITS
#: Members of a posting that are tallied pair by pair; a larger one is split by one more byte position.
POSTING = 512
_CHUNK = 1 << 20


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats included; 0 without words."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])
    n = max(1, len(starts) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        last = ends[at + shingle_words - 1 : to + shingle_words - 1] if len(starts) >= shingle_words else ends[-1:]
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), last.tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp, ``more`` columns of longs): the fingerprint as a signed long."""
    ship(documents.sparkSession)

    def digest(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *more))
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(digest, schema)


def tally_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within one posting: tally the positional bytes that each pair shares, keep the pairs with LEAST_SHARED
    or more, and of those the ones with MAX_BITS or fewer differing bits."""
    octets = members[:, None].view(np.uint8)
    tally = np.zeros((len(members), len(members)), np.uint8)
    for p in range(BYTES):
        tally += octets[:, p, None] == octets[None, :, p]
    i, j = np.nonzero(np.triu(tally >= LEAST_SHARED, 1))
    close = np.bitwise_count(members[i] ^ members[j]) <= MAX_BITS
    return i[close], j[close]


def neighbour_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within a posting whose members share LEAST_SHARED bytes: each looks up its neighbours at one and two bits.

    All pairs have the tally that is asked for, and the posting holds 65,536
    members at most; the lookups are linear in these.
    """
    differ = np.bitwise_or.reduce(members ^ members[0])
    free = [1 << b for b in range(64) if int(differ) >> b & 1]
    flips = [*free, *(a | b for a, b in combinations(free, 2))]
    order = np.argsort(members)
    ordered = members[order]
    left, right = [], []
    for flip in flips:
        other = members ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(ordered, other), len(members) - 1)
        hit = np.flatnonzero((ordered[at] == other) & (members < other))
        left.append(hit)
        right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def first_positions(n: int) -> int:
    """How many byte positions a posting starts with, so that ``n`` spread fingerprints make about as many postings of one."""
    return next((k for k in range(1, LEAST_SHARED) if 256**k >= 64 * n), LEAST_SHARED)


def _masked(chosen: int) -> int:
    """The signed long whose bytes at the chosen positions (a bit each) are set."""
    value = sum(0xFF << (8 * p) for p in range(BYTES) if chosen >> p & 1)
    return value - (1 << 64) if value >> 63 else value


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (src, dst) that connect different fingerprints exactly as all links of <= 2 bits do.

    Inverted index of positional bytes. A posting holds the fingerprints with the
    same bytes at k chosen positions; as two linked fingerprints share six of the
    eight, they share k of the first k + 2, so the choices among these are enough.
    In a posting of up to POSTING members the shared bytes of each pair are
    tallied, pairs with six or more are retained and verified. A larger posting
    is split by one more position: its linked pairs share one of the first three
    that are left. Postings of six positions hold 65,536 members at most. So no
    posting is quadratic in the input, and no pair is lost. Verified links of a
    posting become a star per group, one row per member at most.
    """
    spark = distinct.sparkSession
    ship(spark)
    k = first_positions(distinct.count())
    choices = [sum(1 << p for p in c) for c in combinations(range(k + MAX_BITS), k)]
    keyed = lambda options: F.inline(F.array(*(F.struct(F.lit(c).alias("chosen"), F.col("fp").bitwiseAND(F.lit(_masked(c)).cast("long")).alias("shared")) for c in options)))
    members, found = distinct.select("fp", keyed(choices)), None
    while True:
        level = materialize(
            members.repartition("chosen", "shared").sortWithinPartitions("chosen", "shared").select("chosen", "shared", "fp").mapInArrow(_tally, "chosen int, src long, dst long"), "postings"
        )
        links = level.where("chosen = 0").select("src", "dst")
        found = links if found is None else found.union(links)
        crowded = level.where("chosen <> 0").select("chosen", F.col("src").alias("fp")).distinct()
        if k == LEAST_SHARED or crowded.isEmpty():
            return found
        k += 1
        more = F.lit(None).cast("array<struct<chosen:int,shared:long>>")
        for c in {r["chosen"] for r in crowded.select("chosen").distinct().collect()}:  # 56 choices at most
            left = [p for p in range(BYTES) if not c >> p & 1][: MAX_BITS + 1]
            split = F.array(*(F.struct(F.lit(c | 1 << p).alias("chosen"), F.col("fp").bitwiseAND(F.lit(_masked(c | 1 << p)).cast("long")).alias("shared")) for p in left))
            more = F.when(F.col("chosen") == c, split).otherwise(more)
        members = crowded.select("fp", F.inline(more)).distinct()


def _tally(batches):
    """Rows (chosen, shared, fp) in order of posting -> links (0, src, dst), and the members of larger postings (chosen, fp, 0)."""
    held = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64)]
    crowd = None  # the posting at hand, if it is too large
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        chosen, shared, fp = held
        out = []
        if crowd is not None:
            n = int(np.argmin(np.append((chosen == crowd[0]) & (shared == crowd[1]), False)))
            out.append((chosen[:n], fp[:n], fp[:n] * 0))
            chosen, shared, fp = chosen[n:], shared[n:], fp[n:]
            crowd = None if len(fp) else crowd
        starts = np.flatnonzero(np.diff(chosen, prepend=0).astype(bool) | np.diff(shared, prepend=0).astype(bool))
        last = int(starts[-1]) if len(starts) else 0
        out += _postings(chosen[:last], fp[:last], starts)
        held = [chosen[last:], shared[last:], fp[last:]]
        if len(held[0]) > POSTING and int(held[0][0]).bit_count() < LEAST_SHARED:
            crowd = (held[0][0], held[1][0])
            out.append((held[0], held[2], held[2] * 0))
            held = [h[:0] for h in held]
        yield _linked(out)
    if len(held[0]):
        yield _linked(_postings(held[0], held[2], np.array([0, len(held[0])])))


def _postings(chosen: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> list[tuple]:
    ends = np.append(starts[starts > 0], len(fp))
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    two = starts[sizes == 2]
    a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
    tally = sum(((a ^ b) >> np.uint64(8 * p) & np.uint64(255) == 0).astype(np.int8) for p in range(BYTES))
    close = (tally >= LEAST_SHARED) & (np.bitwise_count(a ^ b) <= MAX_BITS)
    src, dst = np.maximum(a, b)[close].view(np.int64), np.minimum(a, b)[close].view(np.int64)
    out = [(np.zeros(len(src), np.int32), src, dst)]
    for lo, hi in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
        members = np.ascontiguousarray(fp[lo:hi]).view(np.uint64)
        if hi - lo > POSTING and int(chosen[lo]).bit_count() < LEAST_SHARED:
            out.append((chosen[lo:hi], fp[lo:hi], fp[lo:hi] * 0))
            continue
        i, j = tally_links(members) if hi - lo <= POSTING else neighbour_links(members)
        label = np.arange(len(members))
        union(label, i, j)
        apart = np.flatnonzero(label != np.arange(len(members)))
        out.append((np.zeros(len(apart), np.int32), fp[lo:hi][apart], fp[lo:hi][label[apart]]))
    return out


def _linked(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2])], names=["chosen", "src", "dst"])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of two or fewer bits.

    Equal fingerprints form one class with one row in the index, so copies are
    never paired. Null and wordless texts have fingerprint 0 and are linked like
    any other. Repeated rows give repeated results; null doc_ids never name a
    component unless all its doc_ids are null; extra columns are ignored; an
    empty table gives an empty result.
    """
    digest = materialize(fingerprints(documents), "fingerprints")
    named = _classes(digest, F.col("doc_id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = materialize(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp-names")
    return digest.join(names.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def later_rows(documents: DataFrame) -> DataFrame:
    """(_rid) of the rows that are not the first of their class of near-duplicates.

    ``documents`` has row ids (_rid). The first row is the one with the smallest
    doc_id and, of those, the smallest row id; null doc_ids order last. So one
    row of each class stays, whatever the doc_ids.
    """
    digest = materialize(fingerprints(documents, "_rid"), "fingerprints")
    named = _classes(digest, F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_rid").alias("c")))
    firsts = named.groupBy("component").agg(F.min("first")["c"].alias("_rid")).select("_rid")
    return digest.select("_rid").join(firsts.hint("merge"), "_rid", "left_anti")


def _classes(digest: DataFrame, order: Column) -> DataFrame:
    """(fp, first, component): the least ``order`` of each fingerprint's rows, and the class it is linked into."""
    classes = materialize(digest.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    groups = connected_components(near_fingerprints(classes.select("fp")))
    return classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def fingerprint_classes(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
