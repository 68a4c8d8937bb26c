"""State spaces of nets as a level-by-level DataFrame fixpoint."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from markspan.functions.vectors import accelerate, fire, is_enabled, node_id, parent_path
from markspan.plans.compile import CompiledNets, compile_nets

log = logging.getLogger("markspan")

#: Transition tables of up to this many vector cells (4 bytes each) are broadcast; larger ones are joined by net_id.
BROADCAST_CELLS = 8_000_000
#: Jobs whose files the history keeps apart before they are written together.
SEGMENTS = 12
#: Levels per job for nets that need no acceleration.
STRIDE = 8
#: The move that leaves a state as it is.
IDLE = -1
#: A frontier of up to this many states is expanded in one task, without a shuffle between its levels.
SMALL_FRONTIER = 1_000


class StateLimit(RuntimeError):
    """The state space is larger than the caller allows."""


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share, until the application ends; a local session without one gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + os.path.abspath(tempfile.mkdtemp(prefix="markspan-states-"))
    folder = f"{shared.rstrip('/')}/markspan/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def successors(frontier: DataFrame, transitions: DataFrame, broadcast: bool = False) -> DataFrame:
    """Theta join of states with the transitions that they enable: a row for each firing.

    ``frontier`` needs net_id, expand and any other columns, which stay. Ask for
    a broadcast only where the size of ``transitions`` is known.
    """
    right = F.broadcast(transitions) if broadcast else transitions
    joined = frontier.alias("f").join(right.alias("x"), (F.col("f.net_id") == F.col("x.net_id")) & is_enabled("f.expand", "x.pre"))
    return joined.select("f.*", F.col("x.t"), F.col("x.delta"), F.col("x.phantom"))


def explore(nets: DataFrame, strict: bool = True, max_levels: int = 10_000, max_states: int | None = None, compiled: CompiledNets | None = None, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """All states (net_id, path, node_id, marking, depth) of all nets, in the order-independent canonical form.

    Level by level: fire, accelerate against the ancestors (unless the net is
    proven bounded), keep for each new marking the smallest path in integer
    order, drop markings seen on earlier levels, write the level. This gives what
    one worker that takes its tasks first in, first out would find. Nets that are
    proven bounded and the others are explored apart, as the former need fewer
    jobs. ``max_levels`` and ``max_states`` raise StateLimit, they never cut the
    result. ``progress`` is called with the level and the number of states so far.
    """
    spark = nets.sparkSession
    compiled = compiled or compile_nets(nets, strict)
    folder = work_folder(spark)
    compiled.roots.write.parquet(f"{folder}/roots")
    roots = spark.read.parquet(f"{folder}/roots")
    idle = roots.select("net_id", F.lit(IDLE).alias("t"), F.lit(None).alias("pre"), F.lit(None).alias("delta"), F.lit(False).alias("phantom"))
    compiled.transitions.union(idle).write.parquet(f"{folder}/moves")
    moves = spark.read.parquet(f"{folder}/moves")
    small = (moves.where(F.col("t") != IDLE).agg(F.sum(F.size("pre") + F.size("delta"))).first()[0] or 0) <= BROADCAST_CELLS
    found = {r["bounded"]: r["count"] for r in roots.groupBy("bounded").count().collect()}
    parts, total = [], 0
    for bounded in sorted(found, reverse=True):
        run = _Run(spark, f"{folder}/bounded={bounded}", moves, small, strict, bounded)
        try:
            total = run.levels(roots.where(F.col("bounded") == bounded), found[bounded], max_levels, max_states, total, progress)
        finally:
            run.close()
        parts += run.parts
    states = spark.read.schema(_STATE).parquet(*parts) if parts else spark.createDataFrame([], _STATE)
    return states.select("net_id", "path", node_id("path").alias("node_id"), F.col("report").alias("marking"), "depth")


_STATE = "h long, net_id string, expand array<int>, path array<int>, report array<int>, ancestors array<array<int>>, depth int, phantom boolean"
_KEY = ["h", "net_id", "expand"]


class _Run:
    """The levels of some nets in a table that is hash-partitioned (bucketed) by marking, a partition per job.

    New markings are dealt by the same hash, so they meet the history's buckets
    without moving it: a job shuffles its own candidates only. A leading 64-bit
    hash of net and marking makes sorts and comparisons of vectors cheap. Plans
    stay short and alike, and a lost executor costs a job's recomputation at most.
    """

    def __init__(self, spark: SparkSession, folder: str, moves: DataFrame, broadcast: bool, strict: bool, bounded: bool):
        self.spark, self.folder, self.broadcast, self.strict, self.bounded = spark, folder, broadcast, strict, bounded
        self.moves, self.transitions = moves, moves.where(F.col("t") != IDLE)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.parts: list[str] = []
        self.name, self.path, self.written = "", "", 0

    def levels(self, roots: DataFrame, open_rows: int, max_levels: int, max_states: int | None, total: int, progress: Callable[[int, int], None] | None) -> int:
        start = roots.select(
            F.xxhash64("net_id", "expand").alias("h"), "net_id", "expand", F.array().cast("array<int>").alias("path"), "report",
            (F.lit(None) if self.bounded else F.array("report")).cast("array<array<int>>").alias("ancestors"), F.lit(0).alias("depth"), F.lit(False).alias("phantom"),
        )
        self._write(start, 0)
        self.parts.append(f"{self.path}/part=0")
        stride, level = STRIDE if self.strict and self.bounded else 1, 0
        while open_rows:
            if level >= max_levels:
                raise StateLimit(f"over {max_levels} levels")
            if self.written > SEGMENTS:
                self._compact(level)
            here = self.spark.read.schema(_STATE).parquet(self.parts[-1]).where("NOT phantom").where(F.col("depth") == level).drop("phantom")
            if open_rows <= SMALL_FRONTIER:
                here = here.coalesce(1)
            step = min(stride, max_levels - level)
            fresh = self._next_levels(here, step) if stride > 1 else self._next_level(here)
            level += step
            count = Observation()
            self._write(fresh.observe(count, F.count(F.lit(1)).alias("rows"), F.count_if((F.col("depth") == level) & ~F.col("phantom")).alias("open")), level)
            rows, open_rows = count.get["rows"], count.get["open"]
            if rows:  # else there is no part
                self.parts.append(f"{self.path}/part={level}")
            total += rows
            log.info("level %d: %d states, %d since the roots", level, rows, total)
            if progress:
                progress(level, total)
            if max_states is not None and total > max_states:
                raise StateLimit(f"over {max_states} states at level {level}")
        return total

    def _write(self, states: DataFrame, level: int) -> None:
        """Add a part to the table; ``part`` is the level, or -1 for markings that were written together."""
        if not self.name:
            self.name, self.path = f"markspan_{uuid.uuid4().hex}", f"{self.folder}/from={level}"
        rows = states.select(*_STATE_COLUMNS, F.lit(level).alias("part"))
        rows.write.mode("append").partitionBy("part").bucketBy(self.buckets, *_KEY).option("path", self.path).saveAsTable(self.name)
        self.written += 1

    def _compact(self, level: int) -> None:
        """Go on with a new table of all markings seen: many small files are slow to list and to open."""
        old, nothing = self.name, [F.lit(None).cast(kind).alias(c) for c, kind in (("path", "array<int>"), ("report", "array<int>"), ("ancestors", "array<array<int>>"), ("depth", "int"))]
        seen = self.spark.table(old).where("NOT phantom").select(*_KEY, "phantom", *nothing)
        self.name, self.path, self.written = f"markspan_{uuid.uuid4().hex}", f"{self.folder}/from={level}", 0
        self._write(seen, -1)
        self.spark.sql(f"DROP TABLE {old}")

    def close(self) -> None:
        """Forget the table; its files stay."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _unseen(self, rows: DataFrame) -> DataFrame:
        seen = self.spark.table(self.name).where("NOT phantom").select(*_KEY)
        return rows.join(seen.hint("merge"), _KEY, "left_anti")

    def _next_level(self, here: DataFrame) -> DataFrame:
        """The states of a level from those of the one before: fire, accelerate, keep the smallest path, drop what was seen.

        Ancestors are not carried along with the firings: the new states get them
        from their parents. The depth comes from the rows, so that all levels run
        the same compiled code.
        """
        fired = successors(here, self.transitions, self.broadcast)
        child = fire("expand", "delta") if self.bounded else accelerate("ancestors", fire("expand", "delta"))
        made = fired.select(
            "net_id", F.concat("path", F.array("t")).alias("path"), F.when(F.col("phantom"), F.col("report")).otherwise(child).alias("expand"), "phantom", (F.col("depth") + 1).alias("depth")
        )
        real = made.where("NOT phantom").withColumn("h", F.xxhash64("net_id", "expand"))
        fresh = self._unseen(real.groupBy(*_KEY).agg(F.min("path").alias("path"), F.min("depth").alias("depth"))).withColumn("report", F.col("expand"))
        if self.bounded:
            fresh = fresh.withColumn("ancestors", F.lit(None).cast("array<array<int>>"))
        else:
            parents = here.select("net_id", F.col("path").alias("parent"), F.col("ancestors").alias("above"))
            fresh = fresh.withColumn("parent", parent_path("path")).join(parents, ["net_id", "parent"]).withColumn("ancestors", F.concat("above", F.array("expand")))
        fresh = fresh.withColumn("phantom", F.lit(False)).select(*_STATE_COLUMNS)
        if self.strict:
            return fresh
        ghosts = made.where("phantom").select(
            F.xxhash64("net_id", "expand").alias("h"), "net_id", "expand", "path", F.col("expand").alias("report"), F.lit(None).cast("array<array<int>>").alias("ancestors"), "depth", "phantom"
        )
        return fresh.union(ghosts)

    def _next_levels(self, here: DataFrame, steps: int) -> DataFrame:
        """Several levels in one job, for nets that are proven bounded.

        Without acceleration a state's smallest path is the smallest of its shortest
        paths, whose prefixes are such paths too. So markings need not be compared
        with those seen at every level: each step fires from the states that the
        step before has added and carries all others on by an idle move, and keeps
        of each marking the lowest step and there the smallest path.
        """
        moves = F.broadcast(self.moves) if self.broadcast else self.moves
        rests, ahead = F.col("x.t") == IDLE, here.select(*_KEY, F.lit(0).alias("step"), "path")
        for k in range(steps):
            can = rests | ((F.col("f.step") == k) & is_enabled("f.expand", "x.pre"))
            moved = ahead.alias("f").join(moves.alias("x"), (F.col("f.net_id") == F.col("x.net_id")) & can)
            made = moved.select(
                "f.net_id",
                F.when(rests, F.col("f.expand")).otherwise(fire("f.expand", "x.delta")).alias("expand"),
                F.struct((F.col("f.step") + F.when(rests, 0).otherwise(1)).alias("step"), F.when(rests, F.col("f.path")).otherwise(F.concat("f.path", F.array("x.t"))).alias("path")).alias("at"),
            )
            ahead = made.withColumn("h", F.xxhash64("net_id", "expand")).groupBy(*_KEY).agg(F.min("at").alias("at")).select(*_KEY, "at.step", "at.path")
        return self._unseen(ahead).select(
            *_KEY, "path", F.col("expand").alias("report"), F.lit(None).cast("array<array<int>>").alias("ancestors"), F.size("path").alias("depth"), F.lit(False).alias("phantom")
        )


_STATE_COLUMNS = [part.split()[0] for part in _STATE.split(", ")]


def tree_edges(states: DataFrame) -> DataFrame:
    """(net_id, parent_id, child_id, t): the parent follows from the path, without a join."""
    inner = states.where(F.size("path") > 0)
    return inner.select("net_id", node_id(F.slice("path", 1, F.size("path") - 1)).alias("parent_id"), node_id("path").alias("child_id"), F.element_at("path", -1).alias("t"))


def state_counts(states: DataFrame) -> DataFrame:
    """(net_id, n_states, max_depth, n_omega_states)"""
    return states.groupBy("net_id").agg(
        F.count("*").alias("n_states"), F.max("depth").alias("max_depth"), F.count_if(F.exists("marking", lambda x: x == -1)).alias("n_omega_states")
    )


def repeated_markings(states: DataFrame) -> DataFrame:
    """(net_id, marking, n) of markings that occur more than once; none in the result of a strict exploration."""
    return states.groupBy("net_id", "marking").agg(F.count("*").alias("n")).where("n > 1")


def firing_counts(states: DataFrame, compiled: CompiledNets) -> DataFrame:
    """(net_id, n_firings): enabled transitions over all states, duplicates included."""
    cells = compiled.transitions.agg(F.sum(F.size("pre") + F.size("delta"))).first()[0] or 0
    fired = successors(states.withColumn("expand", F.col("marking")), compiled.transitions, cells <= BROADCAST_CELLS)
    return fired.groupBy("net_id").agg(F.count("*").alias("n_firings"))


def explain_node(states: DataFrame, nets: DataFrame, node: str) -> DataFrame:
    """Why nodes are what they are: a row per node whose id starts with ``node`` and per ancestor, parent first.

    (net_id, node_id, step, ancestor_id, ancestor, fired, verdict, mask): verdict is
    ``smaller`` with the first place that holds less, ``grown`` or ``equal``.
    The prefix test is textual, so ``m0_t1`` also selects ``m0_t10``.
    """
    from markspan.functions.vectors import covers, omega_mask
    from markspan.plans.compile import transition_table

    chosen = states.where(node_id("path").startswith(node) & (F.size("path") > 0))
    prefixes = chosen.select("net_id", "node_id", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("n")).withColumn("prefix", F.slice("path", 1, F.col("n")))
    at = states.select("net_id", F.col("path").alias("prefix"), F.col("marking").alias("ancestor"), F.col("node_id").alias("ancestor_id"))
    rows = prefixes.join(at, ["net_id", "prefix"])
    parents = rows.where(F.col("n") == F.size("path") - 1).select("net_id", "node_id", F.col("ancestor").alias("parent"), F.element_at("path", -1).alias("t"))
    fired = parents.join(transition_table(nets).select("net_id", "t", "delta"), ["net_id", "t"]).select("net_id", "node_id", fire("parent", "delta").alias("fired"))
    less = F.array_position(F.zip_with("ancestor", "fired", lambda a, c: (a != -1) & (c != -1) & (c < a)), True) - 1
    mask = omega_mask("ancestor", "fired")
    verdict = F.when(~covers("ancestor", "fired"), F.concat(F.lit("smaller at "), less.cast("string"))).when(F.exists(mask, lambda b: b), "grown").otherwise("equal")
    return rows.join(fired, ["net_id", "node_id"]).select("net_id", "node_id", (F.size("path") - F.col("n")).alias("step"), "ancestor_id", "ancestor", "fired", verdict.alias("verdict"), mask.alias("mask"))
