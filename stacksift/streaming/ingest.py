"""Incremental ingest: a seen-key set with a delta, and one-shot stream runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.checkpoint import shared_folder
from .seen import SeenKeys


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/stacksift-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that is there now, processed by a stream and read back from its sink.

    A stream in update mode has no table to be read back, as each batch holds what has changed only.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"{mode}: only what is appended, or complete, can be read back")
    spark = stream.sparkSession
    folder = work_folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:

        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def append_new(stream: DataFrame, key: str, master: str, delta: str, checkpoint: str, *, buckets: int = 256, words: int = 4):
    """Append rows of unseen keys to ``master`` and write the same rows as the batch's delta.

    The delta is written first and named by batch, and the master and the set of seen keys (beside the master) take what
    the delta has, so a batch that is run again gives the same files. A batch looks into the buckets of that set which it
    touches; neither the master nor the whole set is read.
    """
    spark = stream.sparkSession
    seen = SeenKeys(spark, f"{master.rstrip('/')}_seen", key, dict(stream.dtypes)[key], buckets=buckets, words=words)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{delta}/batch={batch_id}"
        shared_folder(spark)
        seen.unseen(batch.dropDuplicates([key]), batch_id).write.mode("overwrite").parquet(target)
        fresh = spark.read.schema(batch.schema).parquet(target)
        seen.add(fresh, batch_id)
        fresh.write.mode("overwrite").parquet(f"{master}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
