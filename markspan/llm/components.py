"""Connected components of an edge table: one bounded task, or alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.llm.tables import discard, materialize, ship

#: Up to so many edges (16 bytes each, counted first) are solved in one task; more of them by rounds over the cluster.
TASK_EDGES = 500_000


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Link members i to members j, in place: each label leads to the smallest member linked so far and is that member itself."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def connected_components(edges: DataFrame) -> DataFrame:
    """(src long, dst long) -> (node long, component long), component the smallest node reachable.

    Only nodes with an edge to another node appear. No edges, self loops,
    repeated and reversed edges are all fine.
    """
    links = materialize(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "links",
    )
    if links.count() <= TASK_EDGES:
        return _in_one_task(links)
    return _by_rounds(links)


def _in_one_task(links: DataFrame) -> DataFrame:
    ship(links.sparkSession)

    def solve(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        u, v = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        union(label, at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])

    found = materialize(links.repartition(1).mapInArrow(solve, "node long, component long"), "components")
    discard(links)
    return found


def _by_rounds(links: DataFrame) -> DataFrame:
    """Each round links every node to the smallest of its neighbours, first for its larger neighbours and then for its
    smaller ones; rounds go on until nothing changes, a logarithmic number in practice. The minima are written before
    they are joined, so both inputs of each join come through an exchange and adaptive execution can split a hub's
    partition."""
    state = _state(links)
    while True:
        links = _small_star(_large_star(links))
        new = _state(links)
        if new == state:
            break
        state = new
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-min")
    moved = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(moved.distinct(), "large-star")
    discard(links, least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "small-min")
    moved = links.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    discard(links, least)
    return out
