"""Substring search by an index of character trigrams, so a search reads the postings of a few grams and not all texts.

The index is three Parquet folders, all cut by hash buckets: postings (gram, key), how many keys each gram has, and the
texts by key. A pattern's grams are looked up in the counts; a gram that nothing has ends the search, else the rarest few
are intersected, and only texts of keys that have them all are read and tested with ``contains``. The index only narrows,
so results are those of a scan. Patterns of fewer than three characters have no gram and are scanned for.

A gram of very many keys is spread over ``SPREAD`` files of its bucket by the key, and is not looked at where the
pattern has rarer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoint import cut

GRAM, RAREST = 3, 3
#: Characters that take no part in any text: they part the columns of a row.
GAP = "\x00"
SPREAD = 8


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none of a shorter one. Grams across the columns of a row are left out."""
    n = F.char_length(text) - (GRAM - 1)
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(n >= 1, F.filter(F.array_distinct(made), lambda g: ~F.contains(g, F.lit(GAP)))).otherwise(F.array().cast("array<string>"))


def patterns(q: str) -> list[str]:
    """What a query looks for: itself, and itself without hyphens. Where nothing is left, that is in every text."""
    return list(dict.fromkeys((q, q.replace("-", ""))))


class TrigramIndex:
    def __init__(self, spark: SparkSession, folder: str, kind: str = "bigint", buckets: int = 64):
        """``kind`` is the type of the key."""
        self.spark, self.folder, self.kind, self.buckets = spark, folder, kind, buckets

    def _of(self, value: str) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int").alias("bucket")

    def build(self, df: DataFrame, key: str, columns: list[Column]) -> TrigramIndex:
        """Index the texts of ``columns`` by a unique key; nulls are empty texts, rows without a key are left out."""
        rows = df.select(F.col(key).alias("key"), F.concat_ws(GAP, *[F.coalesce(c, F.lit("")) for c in columns]).alias("text")).where("key is not null")
        rows.select("key", "text", self._of("key")).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/texts")
        posted = rows.select("key", F.explode(grams(F.col("text"))).alias("gram")).select("gram", "key", self._of("gram"))
        spread = F.pmod(F.xxhash64("key"), F.lit(SPREAD))
        posted.repartition(self.buckets * SPREAD, "bucket", spread).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.folder}/postings")
        self.postings().groupBy("gram", "bucket").agg(F.count("*").alias("n")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.folder}/counts")
        return self

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{name}")

    def postings(self) -> DataFrame:
        return self._read("postings", f"gram string, key {self.kind}")

    def texts(self) -> DataFrame:
        return self._read("texts", f"key {self.kind}, text string")

    def _grams(self, pattern: str) -> dict[str, int]:
        """The pattern's grams and their buckets."""
        made = sorted({pattern[i : i + GRAM] for i in range(len(pattern) - GRAM + 1)})
        if not made:
            return {}
        rows = self.spark.createDataFrame([(g,) for g in made], "gram string").select("gram", self._of("gram")).collect()
        return {r["gram"]: r["bucket"] for r in rows}

    def rarest(self, pattern: str) -> list[tuple[str, int, int]] | None:
        """(gram, bucket, keys) of the rarest grams; None if the pattern is too short, an empty list if a gram is nowhere."""
        buckets = self._grams(pattern)
        if not buckets:
            return None
        counts = self._read("counts", "gram string, n bigint").where(F.col("bucket").isin(sorted(set(buckets.values()))) & F.col("gram").isin(sorted(buckets)))
        known = {r["gram"]: r["n"] for r in counts.select("gram", "n").collect()}  # a row a gram of the pattern
        if len(known) < len(buckets):
            return []
        return [(g, buckets[g], n) for g, n in sorted(known.items(), key=lambda x: (x[1], x[0]))[:RAREST]]

    def candidates(self, pattern: str) -> DataFrame | None:
        """Keys that have the pattern's rarest grams; None where all texts have to be looked at."""
        some = self.rarest(pattern)
        if some is None:
            return None
        out = None
        for gram, bucket, _ in some:
            own = self.postings().where((F.col("bucket") == bucket) & (F.col("gram") == gram)).select("key")
            out = own if out is None else out.join(own, "key", "left_semi")
        return out if out is not None else self.spark.createDataFrame([], f"key {self.kind}")

    def _holding(self, pattern: str) -> DataFrame:
        texts, found = self.texts(), self.candidates(pattern)
        if found is not None:
            found = cut(found.select("key", self._of("key")))
            buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # at most as many as the index has
            found = found.select("key")
            texts = texts.where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).join(found, "key", "left_semi")
        return texts.where(F.contains("text", F.lit(pattern))).select("key")

    def search(self, q: str) -> DataFrame:
        """key of the rows of which a column holds the query, as given or without hyphens."""
        some = patterns(q)
        if "" in some:
            return self.texts().select("key")
        out = self._holding(some[0])
        for p in some[1:]:
            out = out.unionByName(self._holding(p))
        return out.distinct() if len(some) > 1 else out
