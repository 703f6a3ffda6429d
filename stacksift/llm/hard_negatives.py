"""Hard negatives: for each anchor and positive, the best rows of other labels whose score lies in a band below it.

Vectors are floored to integers. A rotation by the principal axes of all rows puts most of each product into the
leading components. In a task, the partial products of a tile of anchors and rows are accumulated from the front; what
the rest can add is bounded by the norms of the remainders plus a slack for rounding; pairs that cannot enter any list
any more go early, and what is left is verified with integer products, which alone decide.

Anchors are taken in blocks of a stated number of components (``BLOCK_CELLS``), so a broadcast has one size at any size
of the table, and each block is a pass over all rows in two steps: positives, then negatives. Every task keeps a list
of fixed length for each anchor of the block (and each of its positives); the lists meet in a ranking whose groups are
cut to their length on both sides of the shuffle.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; integers are kept
within 2 ** 22 on both sides (components within 16,384), so that products fit a long; a shorter vector counts as filled
up with zeros; a null vec_id is no anchor, keeps its label, and stands last in ties; repeated rows are other rows, and each
repeated anchor returns its own list; an anchor without positives returns nothing; other columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from ..operators.checkpoint import shared_folder

POSITIVES, NEGATIVES = 5, 10
#: The band, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Integers of a vector stay within this.
LARGEST = 2**22
#: Components of the anchors of one block: 8,192 anchors of 64.
BLOCK_CELLS = 2**19
TILE_ROWS, TILE_ANCHORS = 1024, 512
#: Of a tile, the share of pairs above which all of its products are taken at once.
DENSE = 0.05
NEVER = -(2**62)


def quantised(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, q: the rows that take part. Written once, so that row numbers stay."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    part = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    label = F.col("label").cast("long")
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(F.lit(256.0) * x.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return cut(part.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("q")))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Vectors as rows of one array, filled up with zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(sizes), d), values.dtype)
    out[np.arange(d) < sizes[:, None]] = values
    return out


def principal_axes(rows: DataFrame, d: int) -> np.ndarray:
    """Orthogonal axes by falling share of the second moments of all rows. The driver gets d * d sums."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            for lo in range(0, b.num_rows, TILE_ROWS):
                q = _matrix(b.column(0).slice(lo, TILE_ROWS), d).astype("f8")
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["cell", "moment"])

    sums = rows.select("q").mapInArrow(moments, "cell long, moment double").groupBy("cell").agg(F.sum("moment").alias("moment")).toPandas()
    total = np.zeros(d * d)
    total[sums.cell] = sums.moment
    total = total.reshape(d, d)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


class Anchors:
    """A block of anchors: integers, rotated vectors and the norms of their remainders, sorted by label."""

    def __init__(self, table: pa.Table, axes: np.ndarray):
        d = len(axes)
        label = table["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        self.label, self.row = label[order], table["row"].to_numpy()[order]
        self.ids = table["vec_id"].to_numpy()[order]
        self.q = _matrix(table["q"].combine_chunks(), d)[order]
        self.axes = axes
        #: Places up to which products are accumulated, from one to the next.
        self.cuts = sorted({max(1, d * k // 8) for k in (1, 2, 4, 6)}) if d else []
        self.turned, self.rest, self.norm = self.rotate(self.q)
        defect = np.abs(axes.T @ axes - np.eye(d)).sum() if d else 0.0
        self.slack = (64 * max(d, 1) ** 1.5 * np.finfo("f8").eps + 2 * defect)

    def rotate(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        f = q.astype("f8")
        turned = f @ self.axes
        square = turned * turned
        return turned, [np.sqrt(square[:, c:].sum(1)) for c in self.cuts], np.sqrt((f * f).sum(1))


class Best:
    """For each key the first rows by falling score, then rising id, nulls last."""

    def __init__(self, keys: int, size: int):
        self.size = size
        self.score = np.full((keys, size), NEVER)
        self.ids = np.zeros((keys, size), "i8")
        self.null = np.zeros((keys, size), bool)

    @property
    def least(self) -> np.ndarray:
        """What a new score must reach."""
        return self.score[:, -1]

    def add(self, keys: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(keys):
            return
        touched = np.unique(keys)
        keys = np.concatenate([np.repeat(touched, self.size), keys])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        null = np.concatenate([self.null[touched].ravel(), null])
        order = np.lexsort((ids, null, -score, keys))
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        at = np.arange(len(keys))
        rank = at - np.maximum.accumulate(np.where(first, at, 0))
        order, keys, rank = (x[rank < self.size] for x in (order, keys, rank))
        self.score[keys, rank], self.ids[keys, rank], self.null[keys, rank] = score[order], ids[order], null[order]


def survivors(a: Anchors, rows: tuple, ai: np.ndarray, ri: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, integer score) of the pairs of a tile that may lie in a band of the anchor.

    ``low`` and ``high`` have a row for each anchor of the tile and a column for each band; ``allowed`` marks the pairs of unlike labels.
    """
    q, turned, rest, norm = rows
    slack = a.slack * np.outer(a.norm[ai], norm[ri])

    def open_(partial, bound, lo, hi):
        up, down, out = partial + bound, partial - bound, None
        for k in range(lo.shape[-1]):
            one = (up >= lo[..., k]) & (down <= hi[..., k])
            out = one if out is None else out | one
        return out

    if a.cuts:
        c = a.cuts[0]
        partial = a.turned[ai, :c] @ turned[ri, :c].T
        alive = open_(partial, np.outer(a.rest[0][ai], rest[0][ri]) + slack, low[:, None, :], high[:, None, :])
    else:
        partial = np.zeros((len(ai), len(ri)))
        alive = np.ones(partial.shape, bool)
    if allowed is not None:
        alive &= allowed
    i, j = np.nonzero(alive)
    p, last = partial[i, j], a.cuts[0] if a.cuts else 0
    for step, c in enumerate(a.cuts[1:], 1):
        if len(i) > DENSE * alive.size:
            break
        p = p + np.einsum("ij,ij->i", a.turned[ai[i], last:c], turned[ri[j], last:c])
        go = open_(p, a.rest[step][ai[i]] * rest[step][ri[j]] + slack[i, j], low[i], high[i])
        i, j, p, last = i[go], j[go], p[go], c
    return i, j, _integers(a.q[ai], q[ri], i, j)


def _integers(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of the pairs: in doubles where every sum of absolute products is below 2 ** 53, else in longs."""
    x, y = a.astype("f8"), b.astype("f8")
    small = len(x) and len(y) and np.abs(x).sum(1).max() * max(np.abs(y).max(initial=0), 1) < 2**53
    if not small:
        x, y = a.astype("i8"), b.astype("i8")
    if len(i) > DENSE * len(a) * len(b):
        return (x @ y.T)[i, j].astype("i8")
    return np.einsum("ij,ij->i", x[i], y[j]).astype("i8")


def _tiles(a: Anchors, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    d = len(a.axes)
    for b in batches:
        for lo in range(0, b.num_rows, TILE_ROWS):
            part = b.slice(lo, TILE_ROWS)
            row, ids, label, q = (part.column(k) for k in range(4))
            q = _matrix(q, d)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            yield row.to_numpy(), ids.fill_null(0).to_numpy(), null, label.to_numpy(), (q, *a.rotate(q))


LISTED = "key long, score long, vec_id long"


def _listed(best: Best) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(best.score), 4096):
        key, at = np.nonzero(best.score[lo : lo + 4096] > NEVER)
        key = key + lo
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(best.score[key, at]), pa.array(best.ids[key, at], mask=best.null[key, at])], ["key", "score", "vec_id"])


def _find_positives(shared, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value[0]
        best, end = Best(len(a.row), size), np.full((1, 1), np.inf)
        for row, ids, null, label, rows in _tiles(a, batches):
            for one in np.intersect1d(label, a.label):
                ri = np.flatnonzero(label == one)
                lo, hi = np.searchsorted(a.label, [one, one + 1])
                for at in range(lo, hi, TILE_ANCHORS):
                    ai = np.arange(at, min(at + TILE_ANCHORS, hi))
                    i, j, score = survivors(a, rows, ai, ri, best.least[ai, None].astype("f8"), np.broadcast_to(end, (len(ai), 1)), None)
                    go = (score >= best.least[ai[i]]) & (row[ri[j]] != a.row[ai[i]])
                    best.add(ai[i[go]], score[go], ids[ri[j[go]]], null[ri[j[go]]])
        yield from _listed(best)

    return run


def _find_negatives(shared, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, low, high = shared.value
        bands = low.shape[1]
        best = Best(len(a.row) * bands, size)
        for _, ids, null, label, rows in _tiles(a, batches):
            ri = np.arange(len(label))
            for at in range(0, len(a.row), TILE_ANCHORS):
                ai = np.arange(at, min(at + TILE_ANCHORS, len(a.row)))
                floor = np.maximum(low[ai], best.least.reshape(-1, bands)[ai])
                i, j, score = survivors(a, rows, ai, ri, floor.astype("f8"), high[ai].astype("f8"), a.label[ai][:, None] != label[None, :])
                for k in range(bands):
                    go = (score >= floor[i, k]) & (score <= high[ai[i], k])
                    best.add(ai[i[go]] * bands + k, score[go], ids[j[go]], null[j[go]])
        yield from _listed(best)

    return run


def _ranked(lists: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def bands_of(scores: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a negative may have beside each positive; empty where there is no positive."""
    low, high = -((-LOW * scores) // 100), (HIGH * scores) // 100
    return np.where(known, low, 1), np.where(known, high, 0)


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: vec_id divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = quantised(embeddings)
    anchors = rows.where(F.col("vec_id") % every == 0)
    d = rows.agg(F.max(F.size("q"))).first()[0] or 0
    blocks = -(-anchors.count() * max(d, 1) // block_cells)
    axes = principal_axes(rows, d) if blocks else np.zeros((0, 0))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not blocks:
        return spark.createDataFrame([], schema)
    folder = f"{shared_folder(spark).rstrip('/')}/hard-negatives-{uuid.uuid4()}"
    for block in range(blocks):
        _one_block(rows, anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block), axes, positives, negatives).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _one_block(rows: DataFrame, anchors: DataFrame, axes: np.ndarray, positives: int, negatives: int) -> DataFrame:
    spark = rows.sparkSession
    a = Anchors(anchors.toArrow(), axes)
    n = len(a.row)
    found = _ranked(rows.mapInArrow(_find_positives(spark.sparkContext.broadcast((a,)), positives), LISTED), positives).toArrow()
    score, known = np.zeros((n, positives), "i8"), np.zeros((n, positives), bool)
    key, rank = found["key"].to_numpy(), found["rank"].to_numpy() - 1
    score[key, rank], known[key, rank] = found["score"].to_numpy(), True
    low, high = bands_of(score, known)
    lists = rows.mapInArrow(_find_negatives(spark.sparkContext.broadcast((a, low, high)), negatives), LISTED)
    # at most positives * anchors of a block
    own = pa.table({"own": pa.array(key * positives + rank), "anchor_id": pa.array(a.ids[key]), "positive_id": found["vec_id"], "positive_score": found["score"]})
    met = _ranked(lists, negatives).join(F.broadcast(spark.createDataFrame(own, "own long, anchor_id long, positive_id long, positive_score long")), F.col("key") == F.col("own"))
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
