"""Document fingerprints: a bottom-k sketch of the hashes of five-word shingles.

A sketch holds the k smallest distinct shingle hashes of a text. Sketches of parts merge into the
sketch of the whole (``merge``), and give estimates of resemblance, containment and of the number of
distinct shingles. Equal texts have equal sketches.

Defined cases: a null text counts as empty; an empty text has the empty sketch; two empty sketches
resemble each other by 1, an empty and another by 0. Texts of one to four words have one shingle.
Repeated rows stay. Rows of equal doc_id are ordered by their text's hash; a null doc_id comes last.
Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import slices, small_batches, text_or_empty

K = 128


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    take = 2 * k
    while take < len(hashes):
        part = np.unique(np.partition(hashes, take)[:take])
        if len(part) >= k:
            return part[:k]
        take *= 4
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the two shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    distinct = both[np.concatenate([[True], ~same])][:k]
    return float(np.count_nonzero(both[1:][same] <= distinct[-1]) / len(distinct))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, r * union / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(column, k: int = K) -> list[np.ndarray]:
    out = []
    for _, hashes, at in S.shingle_rows(column):
        out += [bottom(hashes[at[i] : at[i + 1]], k) for i in range(len(at) - 1)]
    return out


def sketch_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles (estimate) and fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = sketches(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([distinct_count(x, k) for x in made], pa.float64()), pa.array([encode(x) for x in made], pa.string())], ["doc_id", "n_shingles", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_shingles double, fingerprint string")


#: Rows of a block on average, fewest and most blocks.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 2_000, 96, 20_000


def _cuts(ids: DataFrame, parts: int) -> tuple[list[int], dict[int | None, int]]:
    """Bounds of doc_id between blocks of near equal rows, and into how many pieces a doc_id with many rows is split."""
    parts = max(1, parts)
    made, n, nulls = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    times: dict[int | None, int] = {}
    for c in made or []:
        times[c] = times.get(c, 0) + 1
    hot: dict[int | None, int] = {c: k + 1 for c, k in times.items() if k > 1}
    # such an id has a bound on either side, so the pieces hold it alone
    cuts = sorted(set(times) | {c - 1 for c in hot if c > -(1 << 63)})
    if n and (k := nulls * parts // n + 1) > 1:
        hot[None] = k
    return cuts, hot


def _placed(rows: DataFrame, parts: int) -> tuple[DataFrame, list[tuple[int, int | None, int | None]]]:
    """``rows`` with block and turn (place in it: doc_id downwards, then the text's hash), and of each block its first row's doc_id and turn (no turn: any row of that id may be it).

    Blocks follow descending doc_id, nulls last. Rows of one doc_id follow their texts' hashes, and a doc_id
    with many rows is split into ranges of that hash, so no block grows with it.
    """
    cuts, hot = _cuts(rows.select("doc_id"), parts)
    shared = rows.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        # block 0 has the largest ids; nulls are behind the last bound
        at = len(shared.value) - np.searchsorted(shared.value, ids.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(shared.value) + 1, at), dtype="int32")

    rank = F.xxhash64("text")
    # at most MOST_BLOCKS ids and the pieces of each, as a table: the plan is the same for any number of them
    table = rows.sparkSession.createDataFrame(sorted(hot.items(), key=str), "hot long, pieces int")
    rows = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("hot")), "left") if hot else rows
    pieces = F.coalesce("pieces", F.lit(1)) if hot else F.lit(1)
    piece = F.least(pieces - 1, F.floor((rank.cast("double") / 2.0**64 + 0.5) * pieces)).cast("int")
    # one number for block and piece; at most MOST_BLOCKS of each
    placed = rows.select("doc_id", "text", (block("doc_id").cast("long") * (1 << 20) + piece).alias("block"), rank.alias("turn"))
    light = placed if hot else rows.select("doc_id", (block("doc_id").cast("long") * (1 << 20)).alias("block"))
    if not hot:
        heads = [(r["block"], r["head"], None) for r in light.groupBy("block").agg(F.max("doc_id").alias("head")).collect()]  # a row a block
    else:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "turn"))
        heads = [(r["block"], None if r["first"]["none"] else -int(r["first"]["down"]), r["first"]["turn"]) for r in light.groupBy("block").agg(first.alias("first")).collect()]
    return placed, sorted(heads, key=lambda h: h[0])


def edited_fingerprints(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (see the query's contract).

    The first row of every block is sent to the block before it too (guest = 1), and the first row of
    all to the last block; so each row meets the next one without a window over the whole table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = parts or min(MOST_BLOCKS, max(LEAST_BLOCKS, rows.count() // BLOCK_ROWS))
    placed, heads = _placed(rows, parts)
    order = [b for b, _, _ in heads]
    schema = "__block long, __before long, __head long, __turn long"
    table = spark.createDataFrame([(b, order[i - 1], h, t) for i, (b, h, t) in enumerate(heads)], schema)  # a row a block
    # of the rows that could be a block's first one the sort takes the first
    is_head = F.col("doc_id").eqNullSafe(F.col("__head")) & (F.col("__turn").isNull() | (F.col("turn") == F.col("__turn")))
    here = F.struct(F.col("block").alias("block"), F.lit(0).alias("guest"))
    there = F.struct(F.col("__before").alias("block"), F.lit(1).alias("guest"))
    placed = placed.join(F.broadcast(table), F.col("block") == F.col("__block"))
    placed = placed.select("doc_id", "text", "turn", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("at")).select("doc_id", "text", "turn", "at.block", "at.guest")
    sorted_rows = placed.repartitionByRange(max(1, len(heads)), "block").sortWithinPartitions("block", "guest", F.desc_nulls_last("doc_id"), "turn", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its follower, and its block
        closed = None  # the block whose guest has come
        for b in slices(batches):
            ids, texts, blocks, guest = (b.column(i).to_pylist() for i in range(4))
            prints = sketches(b.column(1), k)
            done = []
            for i, t, at, g, p in zip(ids, texts, blocks, guest, prints, strict=True):
                if held is not None and (at == held[0]):
                    done.append((*held[1:], t, p))
                    held = None
                if g:
                    closed = at
                elif at != closed:
                    held = (at, i, t, p)
            if done:
                yield _edited(done, k)
        if held is not None:  # no follower at all: a table of one row follows itself
            yield _edited([(*held[1:], held[2], held[3])], k)

    return sorted_rows.select("doc_id", "text", "block", "guest").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained_edited double")


def _edited(done: list[tuple], k: int) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for _, t, _, f, _ in done]
    prints = sketches(pa.array(edited, pa.large_string()), k)
    columns = [
        pa.array([i for i, *_ in done], pa.int64()),
        pa.array([len(t) for _, t, *_ in done], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([encode(p) for _, _, p, _, _ in done], pa.string()),
        pa.array([encode(p) for p in prints], pa.string()),
        pa.array([resemblance(d[2], p, k) for d, p in zip(done, prints, strict=True)], pa.float64()),
        pa.array([resemblance(d[2], d[4], k) for d in done], pa.float64()),
        pa.array([distinct_count(d[2], k) for d in done], pa.float64()),
        pa.array([containment(d[2], p, k) for d, p in zip(done, prints, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained_edited"])
