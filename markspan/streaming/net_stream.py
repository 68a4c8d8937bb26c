"""Net documents that arrive in a folder, explored as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markspan.operators.reachability import explore
from markspan.sources.nets import _BODY


def read_net_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of nets, one per JSON file; ``net_id`` is the file's name without extension."""
    docs = spark.readStream.schema(_BODY).option("multiLine", True).option("mode", "FAILFAST").option("maxFilesPerTrigger", max_files).json(folder)
    return docs.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("net_id"), *docs.columns)


def explore_stream(nets: DataFrame, out: str, checkpoint: str, strict: bool = True, available_now: bool = True) -> StreamingQuery:
    """Explore each micro-batch of nets and write its states under ``out``/batch=<n>.

    A batch that is run again after a failure overwrites its own folder, so every
    net's states are there once.
    """

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            explore(batch, strict).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = nets.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
