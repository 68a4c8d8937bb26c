"""Near-duplicate vectors by PCA-ordered tiled comparison with early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.components import connected_components, union
from markspan.llm.tables import BROADCAST_ROWS, discard, materialize, ship

#: Rows of a tile, and bytes of its double-precision matrix; a leaf of up to twice as many rows is one tile.
TILE_ROWS, TILE_BYTES = 4_096, 1 << 22
#: Tiles that a task holds while others stream past.
GROUP_TILES = 16
#: Bound of the sample that the axes and the order of tiles are fitted on.
SAMPLE_ROWS = 10_000
LEAF_SAMPLE = 16
FIRST_DIMS, STEP_DIMS = 24, 16
#: Far above the rounding of double and single precision sums of products of unit vectors.
SAFE, SAFE_SINGLE = 1e-9, 1e-5
#: Rows multiplied, and pairs finished, at a time.
_BLOCK, _PAIRS = 64, 1 << 15


def pca_basis(unit: np.ndarray) -> np.ndarray:
    """Orthonormal columns in falling order of the second moment of unit vectors (dot products keep their values)."""
    _, vectors = np.linalg.eigh(unit.T @ unit)
    return np.ascontiguousarray(vectors[:, ::-1])


def build_tree(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, float]]:
    """Splits (direction, value) of each inner node in heap order.

    A node splits its sample along the sample's own leading axis: at the widest
    gap between its quartiles if that is a tenth of their distance, so that
    clusters stay whole, else at the median.
    """
    nodes: list[tuple[np.ndarray, float]] = []
    groups = [points]
    for _ in range(depth):
        following = []
        for g in groups:
            if len(g) < 2:
                axis, cut = np.zeros(points.shape[1]), 1.0  # all to the left
            else:
                axis = np.linalg.eigh(np.cov(g.T).reshape(g.shape[1], -1))[1][:, -1]
                at = np.sort(g @ axis)
                lo, hi = (len(at) - 1) // 4, max((len(at) - 1) // 4 + 1, 3 * len(at) // 4)
                k = lo + int(np.argmax(np.diff(at[lo : hi + 1])))
                hole = at[k + 1] - at[k] >= 0.1 * (at[hi] - at[lo])
                cut = float(at[k] + at[k + 1]) / 2 if hole else float(np.median(at))
            nodes.append((axis, cut))
            side = g @ axis >= cut
            following += [g[~side], g[side]]
        groups = following
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[np.ndarray, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    for n, (axis, cut) in enumerate(nodes):
        here = np.flatnonzero(at == n)
        if len(here):
            at[here] = 2 * n + 1 + (points[here] @ axis >= cut)
    return at - len(nodes)


def ball(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre (a unit vector) and the largest angle from it to any of the unit vectors."""
    centre = unit.sum(axis=0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-6 else unit[0]
    return centre, float(np.arccos(np.clip((unit @ centre).min(), -1.0, 1.0)))


def out_of_reach(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float], threshold: float) -> bool:
    """No vector of ball a can have a cosine >= threshold with one of ball b."""
    return float(np.arccos(np.clip(a[0] @ b[0], -1.0, 1.0))) - a[1] - b[1] > _most_angle(threshold)


def _most_angle(threshold: float) -> float:
    return float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6


class Tile:
    """Rows of one tile: the vectors as stored, scaled by powers of two, and as unit vectors along the principal axes."""

    def __init__(self, raw: np.ndarray, basis: np.ndarray):
        self.raw = scaled(raw)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw))
        self.unit = (self.raw / self.norm[:, None]) @ basis
        self.ball = ball(self.unit)
        squares = np.cumsum((self.unit * self.unit)[:, ::-1], axis=1)[:, ::-1]
        self.tails = np.concatenate([np.sqrt(np.maximum(0.0, squares)), np.zeros((len(raw), 1))], axis=1)
        k = min(FIRST_DIMS, raw.shape[1])
        # leading coordinates and, as one more, the suffix norm: a product of two such rows bounds the dot product
        self.lead = np.concatenate([self.unit[:, :k], self.tails[:, k : k + 1]], axis=1).astype(np.float32)


def scaled(raw: np.ndarray) -> np.ndarray:
    """Double precision with the largest component of each row in [0.5, 1): by powers of two, so without rounding."""
    x = raw.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def link_blocks(a: Tile, b: Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j within one tile, with cosine >= threshold, block by block.

    The first leading coordinates are multiplied at once; a pair whose dot
    product over these and whose suffix norms' product cannot reach the
    threshold drops out. The pairs that stay go on by STEP_DIMS coordinates
    under the same bound. What ends within SAFE of the threshold is decided by
    the vectors as stored: dot product over product of norms.
    """
    dims = a.unit.shape[1]
    for lo in range(0, len(a.unit), _BLOCK):
        rows = slice(lo, lo + _BLOCK)
        alive = a.lead[rows] @ b.lead.T >= np.float32(threshold - SAFE_SINGLE)
        if same:
            alive &= np.arange(lo, lo + len(alive))[:, None] < np.arange(len(b.unit))[None, :]
        if np.count_nonzero(alive) * 10 > alive.size:  # crowded: whole products
            dots = a.unit[rows] @ b.unit.T
            alive &= dots >= threshold - SAFE
            i, j = np.nonzero(alive)
            found = [(i + lo, j, dots[i, j])]
        else:
            i, j = np.divmod(np.flatnonzero(alive), len(b.unit))
            found = [_finished(a, b, i[at : at + _PAIRS] + lo, j[at : at + _PAIRS], threshold, dims) for at in range(0, len(i), _PAIRS)]
        for i, j, dot in found:
            near = np.flatnonzero(dot < threshold + SAFE)
            if len(near):
                p, q = i[near], j[near]
                stay = np.ones(len(i), bool)
                stay[near] = np.einsum("ij,ij->i", a.raw[p], b.raw[q]) / (a.norm[p] * b.norm[q]) >= threshold
                i, j = i[stay], j[stay]
            if len(i):
                yield i, j


def _finished(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray, threshold: float, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dot = np.zeros(len(i))
    for k in range(0, dims, STEP_DIMS):
        to = min(dims, k + STEP_DIMS)
        dot = dot + np.einsum("ij,ij->i", a.unit[i, k:to], b.unit[j, k:to])
        stay = dot >= threshold - SAFE - a.tails[i, to] * b.tails[j, to]
        i, j, dot = i[stay], j[stay], dot[stay]
    return i, j, dot


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, basis: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of ``link_blocks`` of two matrices of vectors."""
    axes = np.eye(a.shape[1]) if basis is None else basis
    first = Tile(a, axes)
    found = list(link_blocks(first, first if same else Tile(b, axes), threshold, same))
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _vectors(frame: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return frame.where(_is_vector(id_col, vec_col)).select(F.col(id_col).cast("long").alias("id"), F.transform(_kept(frame, vec_col), lambda x: x + F.lit(0)).alias("v"))


def _kept(frame: DataFrame, vec_col: str) -> Column:
    """Single precision stays as it is stored, which halves what is moved; all else becomes double precision."""
    kind = dict(frame.dtypes)[vec_col]
    return F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = scaled(flat.reshape(-1, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(distinct: DataFrame, dims: int, count: int, threshold: float, tile_rows: int, group_tiles: int) -> tuple[DataFrame, int]:
    """The number of tiles and (kind, a, b): kind 0 links of row a to b other vectors found in one pair of groups, kind 1 an
    edge of the components, kind 2 the number a of pairs of tiles compared."""
    spark = distinct.sparkSession
    ship(spark)
    every = max(1, count // SAMPLE_ROWS)
    sample = distinct.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("v").limit(2 * SAMPLE_ROWS).collect()
    if not sample:
        sample = distinct.select("v").limit(SAMPLE_ROWS).collect()
    unit = _unit(np.array([r["v"] for r in sample], dtype=np.float64), dims)
    basis = pca_basis(unit)
    stored = dict(distinct.dtypes)["v"]
    kind = "<f4" if stored == "array<float>" else "<f8"
    tile_rows = max(1, min(tile_rows, TILE_BYTES // (8 * dims)))
    # the sample bounds the leaves; crowded leaves are dealt into several tiles
    depth = max(0, min(-(-count // tile_rows), len(unit) // LEAF_SAMPLE) - 1).bit_length()
    nodes = build_tree(unit, depth)
    shared = spark.sparkContext.broadcast((basis, nodes))

    def place(batches):
        nodes = shared.value[1]
        for batch in batches:
            points = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False), dims) if batch.num_rows else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(points, nodes).astype(np.int32))], names=["key", "v", "n", "leaf"])

    placed = materialize(distinct.select("key", "v", "n").mapInArrow(place, f"key long, v {stored}, n long, leaf int"), "placed")
    crowd = dict(placed.groupBy("leaf").count().collect())
    parts = {leaf: 1 if n <= 2 * tile_rows else -(-n // tile_rows) for leaf, n in sorted(crowd.items())}
    first = dict(zip(parts, np.concatenate([[0], np.cumsum(list(parts.values()))]).tolist(), strict=False))
    by_leaf = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("leaf")]
    tiled = placed.withColumn("tile", (by_leaf(first) + F.pmod(F.xxhash64("key", F.lit(1)), by_leaf(parts))).cast("long"))
    n_tiles = sum(parts.values())

    def pack(table: pa.Table) -> pa.Table:
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids, ns = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype("<i8") for c in ("key", "n"))
        centre, angle = ball(_unit(values, dims) @ shared.value[0])
        return pa.table({"tile": table.column("tile")[:1], "ids": [ids.tobytes()], "ns": [ns.tobytes()], "matrix": [values.tobytes()], "centre": [centre.tolist()], "angle": [angle]})

    # tiles that follow each other form groups; a pair of groups is a task, so a tile moves once per group
    groups = max(-(-n_tiles // group_tiles), min(n_tiles, int((8 * spark.sparkContext.defaultParallelism) ** 0.5)))
    grouped = tiled.groupBy("tile").applyInArrow(pack, "tile long, ids binary, ns binary, matrix binary, centre array<double>, angle double")
    tiles = materialize(grouped.withColumn("g", F.floor(F.col("tile") * groups / n_tiles).cast("int")), "tiles")
    discard(placed)
    meet = materialize(_meetings(tiles, groups, threshold), "meetings")
    pairs = meet.count()
    to = F.broadcast(meet) if pairs <= BROADCAST_ROWS else meet.hint("merge")
    dealt = tiles.drop("centre", "angle").join(to, "g").repartition(max(1, min(pairs, 8 * groups * groups)), "low", "high").sortWithinPartitions("low", "high", "second", "tile")

    def compare(batches):
        basis = shared.value[0]
        at, held, out = None, [], []
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(k)[row].as_py() for k, n in enumerate(batch.schema.names)}
                if (cell["low"], cell["high"]) != at:
                    if at:
                        yield _found(held, out)
                    at, held, out = (cell["low"], cell["high"]), [], []
                tile = Tile(np.frombuffer(cell["matrix"], kind).reshape(-1, dims), basis)
                tile.ids, tile.ns = np.frombuffer(cell["ids"], "<i8"), np.frombuffer(cell["ns"], "<i8")
                tile.links = np.zeros(len(tile.ids), np.int64)
                own = at[0] == at[1]
                if own or cell["second"]:
                    out += [_against(other, tile, threshold) for other in held]
                if own:
                    out.append(_against(tile, tile, threshold))
                if cell["second"]:
                    out.append(_links_of(tile))
                else:
                    held.append(tile)
        if at:
            yield _found(held, out)

    columns = ["low", "high", "second", "ids", "ns", "matrix"]
    found = materialize(dealt.select(*columns).mapInArrow(compare, "kind int, a long, b long"), "tile-links")
    discard(tiles, meet)
    return found, n_tiles


def _meetings(tiles: DataFrame, groups: int, threshold: float) -> DataFrame:
    """(g, low, high, second): the pairs of groups that each group's tiles go to, without those whose balls are out of reach."""

    def around(table: pa.Table) -> pa.Table:
        centres = np.array(table.column("centre").to_pylist())
        centre, _ = ball(centres)
        reach = np.arccos(np.clip(centres @ centre, -1.0, 1.0)) + table.column("angle").to_numpy()
        return pa.table({"g": table.column("g")[:1], "c": [centre.tolist()], "r": [float(reach.max())]})

    balls = materialize(tiles.select("g", "centre", "angle").groupBy("g").applyInArrow(around, "g int, c array<double>, r double"), "groups")
    left = balls.select(F.col("g").alias("low"), "c", "r", F.explode(F.sequence("g", F.lit(groups - 1))).alias("high"))
    right = balls.select(F.col("g").alias("high"), F.col("c").alias("d"), F.col("r").alias("q"))
    dot = F.aggregate(F.zip_with("c", "d", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("r") - F.col("q")
    pairs = left.join(right, "high").where((apart <= _most_angle(threshold)) | (F.col("low") == F.col("high")))
    return pairs.select(F.col("low").alias("g"), "low", "high", F.lit(False).alias("second")).union(pairs.where("low <> high").select("high", "low", "high", F.lit(True)))


def _against(a: Tile, b: Tile, threshold: float) -> pa.RecordBatch:
    """Count the links between two tiles into the tiles' rows; returns the edges that join the linked vectors."""
    same = a is b
    if not same and out_of_reach(a.ball, b.ball, threshold):
        return _rows(2, np.zeros(0, np.int64), np.zeros(0, np.int64))
    off = 0 if same else len(a.ids)
    label = np.arange(off + len(b.ids))
    for i, j in link_blocks(a, b, threshold, same):
        a.links += np.bincount(i, weights=b.ns[j], minlength=len(a.ids)).astype(np.int64)
        b.links += np.bincount(j, weights=a.ns[i], minlength=len(b.ids)).astype(np.int64)
        union(label, i, j + off)
    every = b.ids if same else np.concatenate([a.ids, b.ids])
    apart = np.flatnonzero(label != np.arange(len(label)))
    return pa.concat_batches([_rows(1, every[apart], every[label[apart]]), _rows(2, np.ones(1, np.int64), np.zeros(1, np.int64))])


def _links_of(tile: Tile) -> pa.RecordBatch:
    some = np.flatnonzero(tile.links)
    return _rows(0, tile.ids[some], tile.links[some])


def _found(held: list[Tile], out: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches([*out, *map(_links_of, held)])


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def near_links(embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int = TILE_ROWS, group_tiles: int = GROUP_TILES) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of cosine >= threshold, in double precision, over all rows.

    Equal vectors are one row of the comparison with their number as weight, so
    copies are never paired. The different ones are rotated to principal axes
    and ordered into tiles of bounded size by splits along the leading axes
    (both fitted on about SAMPLE_ROWS rows by a hash of the id; any rotation and
    any order give the same links). A tile has a ball around its vectors; pairs
    of tiles, and of groups of tiles, whose balls are out of reach are skipped.
    A task holds one group of tiles while another streams past, and returns
    counts and a spanning star per group of links, not pairs. On vectors without
    structure all tiles are in reach, so the work is quadratic, if by a small
    factor (most pairs end after the first FIRST_DIMS coordinates).

    The cosine is the dot product over the product of the norms, in double
    precision on the vectors as stored (scaled by powers of two), so a cosine of
    just the threshold links. A vector that is null, empty, all zero or holds
    null or non-finite numbers links with nothing; nor do vectors of different
    lengths. A null id links with nothing and is its own null component with kept
    true. Repeated rows are other vectors that link; other columns are ignored.
    An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    table = materialize(_vectors(embeddings, id_col, vec_col), "vectors")
    different = table.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    distinct = materialize(different.select(F.monotonically_increasing_id().alias("key"), "id", "v", "n"), "different-vectors")
    counts = dict(distinct.groupBy(F.size("v").alias("d")).count().collect())
    parts = [_compare(distinct.where(F.size("v") == dims), dims, counts[dims], threshold, tile_rows, group_tiles)[0] for dims in sorted(counts)]
    found = spark.createDataFrame([], "kind int, a long, b long")
    for part in parts:
        found = found.union(part)
    linked = connected_components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "key")
    least = linked.join(distinct.select("key", "id"), "key").groupBy("component").agg(F.min("id").alias("least"))
    names = linked.join(least, "component").select("key", "least")
    links = found.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("others"))
    classes = materialize(
        distinct.join(links, "key", "left").join(names, "key", "left").select("v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id")),
        "vector-classes",
    )
    discard(distinct, *parts)
    of_row = table.join(classes.hint("merge"), "v").select("id", "n_links", "component_id")
    rest = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).where(~_is_vector(id_col="id", vec_col=vec_col))
    single = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return of_row.union(single).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _is_vector(id_col: str, vec_col: str) -> Column:
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine, F.lit(False))
