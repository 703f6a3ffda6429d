"""Sharding along a Hilbert curve over several metadata dimensions.

Language, source, size and doc_id are quantised to BITS bits each, by bounds that deal out the rows evenly:
each level is a range of the dimension's own order, whole texts included, so the
least and greatest value of a file tell a reader what is not in it; the curve index of that cell orders
the rows, so a run of the order covers a compact box of every dimension and a reader that filters on any
of them can skip most files. Runs of equal row counts are the shards (law ``rows``: counts differ by at
most one).

A cell can hold a large share of all rows (one hot source), so ranks are made in two steps: rows of a
cell are dealt by hash into slices, counts of slices are summed up to offsets, and rows are numbered
within their slice. No window covers the table or a whole cell.

Defined cases: null lang or source is a value of its own, a null text has no bytes and the checksum of
the empty text, a null doc_id sorts first; repeated rows each get a slot; an empty table gives no rows.
Columns besides doc_id, text, lang and source are ignored by ``assign`` and written by ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 3
SHARDS = 24
ROWS_A_SLICE = 100_000


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve index of each row of ``axes`` (n x d integers below 2**bits), by the transpose method."""
    x = axes.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _cuts(df: DataFrame, column: str, bits: int) -> list:
    made = df.agg(F.percentile_approx(column, [i / 2**bits for i in range(1, 2**bits)], 1000)).first()[0]
    return sorted(set(made or []))


def _level(column: str, cuts: list):
    value = F.lit(0)
    for c in cuts:
        value = value + F.when(F.col(column) > F.lit(c), 1).otherwise(0)
    return value


def _text_cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """Exact bounds of whole texts that deal out the rows evenly; nulls come before all texts.

    Rows are counted by value, the values are dealt by range, and running counts are made within a range, each from
    the total of the ranges before it (a row a range). So neither a hot value nor very many values meet in one task.
    """
    values = df.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(F.col(column).asc_nulls_first())
    values = cut(values.withColumn("range", F.spark_partition_id()))
    totals = sorted((r["range"], r["n"]) for r in values.groupBy("range").agg(F.sum("n").alias("n")).collect())
    if not totals:
        return []
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])])
    starts = df.sparkSession.createDataFrame([(k, int(b)) for (k, _), b in zip(totals, before, strict=False)], "range int, before long")
    running = F.sum("n").over(Window.partitionBy("range").orderBy(F.col(column).asc_nulls_first())) + F.col("before")
    at = values.join(F.broadcast(starts), "range").select(column, running.alias("to"))
    made = at.agg(*[F.min(F.when(F.col("to") >= int(before[-1]) * i / 2**bits, F.col(column))) for i in range(1, 2**bits)]).first()
    return sorted({c for c in made if c is not None})


def _with_curve(docs: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """doc_id, lang, source, size, text_crc32, curve and slice of every row, as a table of its own, and their number."""

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c, d], axis=1), bits))

    meta = cut(docs.select(*_key(docs)))
    n = meta.count()
    slices = max(64, n // ROWS_A_SLICE)
    levels = [_level("lang", _text_cuts(meta, "lang", bits)), _level("source", _text_cuts(meta, "source", bits)), _level("size", _cuts(meta, "size", bits))]
    by_id = F.coalesce(_level("doc_id", _cuts(meta, "doc_id", bits)), F.lit(0))
    return cut(meta.select("doc_id", "lang", "source", "size", "text_crc32", curve(*levels, by_id).alias("curve"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slices)).cast("int").alias("slice"))), n


def _key(docs: DataFrame) -> list:
    text = F.col("text").cast("string")
    return [
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    ]


def _ranked(at: DataFrame) -> DataFrame:
    """``at`` with the place of every row along the curve."""
    counts = at.groupBy("curve", "slice").agg(F.count("*").alias("n"))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("n"))  # at most 2**(4 * bits) rows
    cells = cells.select("curve", (F.sum("n").over(Window.orderBy("curve")) - F.col("n")).alias("before"))
    inside = counts.select("curve", "slice", (F.sum("n").over(Window.partitionBy("curve").orderBy("slice")) - F.col("n")).alias("within"))
    starts = inside.join(F.broadcast(cells), "curve").select("curve", "slice", (F.col("before") + F.col("within")).alias("start"))
    order = Window.partitionBy("curve", "slice").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size", F.asc_nulls_first("lang"), F.asc_nulls_first("source"))
    return at.withColumn("rank", F.row_number().over(order)).join(starts, ["curve", "slice"]).withColumn("at", F.col("start") + F.col("rank") - 1)


def _shard(ranked: DataFrame, n: int, shards: int) -> DataFrame:
    return ranked.withColumn("shard", F.expr(f"cast(at * {shards} div {max(n, 1)} as int)")).withColumn("slot", F.expr(f"cast(at - (shard * {n}L + {shards} - 1) div {shards} as bigint)"))


def assign(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of every row."""
    at, n = _with_curve(docs, bits)
    return _shard(_ranked(at), n, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS, rows_a_file: int = 250_000) -> None:
    """Write ``docs`` as one folder a shard, rows in curve order and ``rows_a_file`` to a file at most about; for file pruning.

    A row finds its place by what the order is made of: rows that agree in all of it are as good as each
    other, so those with one key are numbered on both sides and meet by number. Shards have the counts of ``assign``.
    """
    at, n = _with_curve(docs, bits)
    key = ["doc_id", "lang", "source", "size", "text_crc32"]
    same = Window.partitionBy(*key)
    places = _shard(_ranked(at), n, shards).select(*[F.col(c).alias(f"__{c}") for c in key], "shard", "slot")
    places = places.withColumn("__copy", F.row_number().over(Window.partitionBy(*[f"__{c}" for c in key]).orderBy("shard", "slot"))).select(*[f"__{c}" for c in key], "__copy", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("__row"), *_key(docs)).withColumn("__number", F.row_number().over(same.orderBy(F.lit(0))))
    met = rows["__number"] == places["__copy"]
    for c in key:
        met = met & rows[c].eqNullSafe(places[f"__{c}"])
    placed = rows.join(places, met).select("__row", "__shard", "__slot")
    files = max(shards, -(-n // rows_a_file))
    placed = placed.repartitionByRange(files, "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    placed.select("__row.*", F.col("__shard").alias("shard_id")).write.partitionBy("shard_id").parquet(path)
