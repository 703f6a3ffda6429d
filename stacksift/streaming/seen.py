"""A set of seen keys of which a batch reads only what it touches.

Keys are written in hash buckets, each batch's beside those of earlier ones. Over them lie Bloom filters: bitmaps of 32,768
bits, ``words`` of them a bucket, to one of which each key belongs. A key that its filter does not have is new without a
look at the keys; for the others the buckets that they fall into are read, and no more. A filter has about a byte for each
key, so a batch reads far less than the set and its cost follows the batch.

Both are Parquet folders by batch and bucket. What a batch writes is named by it and replaced when it is run again, and a
batch does not see its own entries, so a repeated batch gives the same result. ``compact`` puts the batches so far into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap of the engine's bitmap functions, and how many of them a key sets.
BITS, PROBES = 32_768, 7
COMPACTED = -1


class SeenKeys:
    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str, *, buckets: int = 256, words: int = 4):
        """``kind`` is the key's type; ``words`` bitmaps a bucket do for 3,400 keys each at one false hit in a hundred."""
        self.spark, self.key, self.kind, self.buckets, self.words = spark, key, kind, buckets, words
        self.keys, self.filters = f"{folder}/keys", f"{folder}/filters"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, path: str, schema: str, batch: int | None) -> DataFrame:
        if not self._there(path):
            return self.spark.createDataFrame([], f"{schema}, batch long, bucket int")
        df = self.spark.read.schema(f"{schema}, batch long, bucket int").parquet(path)
        return df if batch is None else df.where(F.col("batch") != batch)

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.col(self.key), F.lit(seed))

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the key's bucket, word and bits."""
        bits = F.array(*[F.pmod(self._hash(3 + i), F.lit(BITS)).cast("int") for i in range(PROBES)])
        return df.withColumns({"bucket": F.pmod(self._hash(1), F.lit(self.buckets)).cast("int"), "word": F.pmod(self._hash(2), F.lit(self.words)).cast("int"), "bits": bits})

    def _only(self, df: DataFrame, touched: DataFrame) -> DataFrame:
        """The buckets that ``touched`` has, by folder; their numbers are collected, at most ``buckets`` of them."""
        some = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        return df.where(F.col("bucket").isin(some) if some else F.lit(False))

    def known_filters(self, placed: DataFrame, batch: int | None = None) -> DataFrame:
        """bucket, word and bitmap of the buckets that a placed batch touches."""
        some = self._only(self._read(self.filters, "word int, bitmap binary", batch), placed)
        return some.groupBy("bucket", "word").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def known_keys(self, maybe: DataFrame, batch: int | None = None) -> DataFrame:
        """Keys of the buckets that hold a key which its filter has."""
        return self._only(self._read(self.keys, f"`{self.key}` {self.kind}", batch), maybe).select(self.key)

    def unseen(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """The rows of ``df`` (one a key) whose key is not in the set; null keys are none."""
        plain = df.columns
        placed = self.placed(df.where(F.col(self.key).isNotNull()))
        tested = placed.join(self.known_filters(placed, batch), ["bucket", "word"], "left")
        tested = tested.withColumn("maybe", F.col("bitmap").isNotNull() & F.forall("bits", lambda b: _bit(F.col("bitmap"), b))).drop("bitmap", "bits", "word").persist()
        try:
            maybe = tested.where("maybe")
            rest = maybe.join(self.known_keys(maybe, batch), self.key, "left_anti")
            # materialised while it is kept, since callers write it more than once
            return tested.where("not maybe").unionByName(rest).select(*plain).checkpoint()
        finally:
            tested.unpersist()

    def add(self, df: DataFrame, batch: int) -> None:
        """The keys of ``df`` as those of ``batch``, in place of what the batch had written before."""
        placed = self.placed(df.select(self.key).distinct())
        placed.select(self.key, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.keys}/batch={batch}")
        ones = placed.select("bucket", "word", F.explode("bits").alias("bit"))
        filters = ones.groupBy("bucket", "word").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))  # positions count from one
        filters.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.filters}/batch={batch}")

    def compact(self, folder: str) -> SeenKeys:
        """The set in a new folder, as one batch; the caller changes over to it."""
        out = SeenKeys(self.spark, folder, self.key, self.kind, buckets=self.buckets, words=self.words)
        out.add(self._read(self.keys, f"`{self.key}` {self.kind}", None), COMPACTED)
        return out


def _bit(bitmap: Column, at: Column) -> Column:
    """Whether a bit of a bitmap is set: the byte is cut out, not the bitmap decoded."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def false_hits(seen: SeenKeys, strangers: DataFrame) -> float:
    """Share of keys, none of them in the set, that its filters let through; more than a few in a hundred ask for more words."""
    placed = seen.placed(strangers)
    tested = placed.join(seen.known_filters(placed), ["bucket", "word"], "left")
    hit = F.col("bitmap").isNotNull() & reduce(lambda a, b: a & b, [_bit(F.col("bitmap"), F.col("bits")[i]) for i in range(PROBES)])
    return tested.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))).first()[0]
