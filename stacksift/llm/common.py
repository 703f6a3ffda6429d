"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoint import cut  # noqa: F401 - the operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows that a Python task works on at once.
SLICE_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2 * SLICE_ROWS rows from here on: ten thousand long texts are too many for one buffer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 2 * SLICE_ROWS:
        spark.conf.set(name, str(2 * SLICE_ROWS))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_ROWS rows, so what a task makes of one stays small.

    At the end of the task unused memory goes back to the system, since workers live on.
    """
    for b in batches:
        for lo in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(lo, SLICE_ROWS)
    pa.default_memory_pool().release_unused()


def packed(docs: DataFrame):
    """All columns of a table in one struct, so that an operator's own columns cannot meet them, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id="doc_id"):
    """The fold that no model may learn from: crc32 of the id's decimal text, divisible by five."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
