"""Shared table helpers: scratch tables, size-checked broadcasts, row ids."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of a checked number may be broadcast up to this many rows (8 bytes each, some 25 MB as a hash table).
BROADCAST_ROWS = 500_000

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_OWN_DIR: list[str] = []
_SCOPES: list[list[DataFrame]] = []


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers.

    Those that share this file system can import the package (a cluster ships it
    with --py-files), and batches of rows are bounded by their bytes, unless the
    session says otherwise: texts may be long.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local session without one gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="markspan-"))
    return f"file://{os.path.abspath(_OWN_DIR[0])}"


def materialize(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    The table goes when the application ends, or before that by ``discard``.
    ``small`` is for sums whose number does not grow with the rows: a file for
    every fourth shuffle partition, as each file costs an executor a new process
    or two on some file systems.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/markspan/{uuid.uuid4().hex}-{tag}"
    if small:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for made in _SCOPES:
        made.append(out)
    return out


@contextmanager
def scratch_scope() -> Iterator[list[DataFrame]]:
    """Delete at the end all tables that are written within, but for those taken off the list."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for table in tables:
        where, files = _hadoop(table.sparkSession, table._scratch)
        files.delete(where, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def with_row_id(df: DataFrame, tag: str, name: str = "_rid") -> DataFrame:
    """A written table with a row id: partition number << 33 plus the row's index in it, fixed by the write."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), tag)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of wide rows on a written table of ids.

    The ids' number is checked: up to BROADCAST_ROWS they are broadcast, so that
    the wide rows are not shuffled; beyond that both sides meet in a sort-merge
    join, whose skewed partitions adaptive execution splits.
    """
    ids = ids.select(key).distinct() if how == "left_semi" else ids.select(key)
    small = ids.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has them, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_size(text) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

