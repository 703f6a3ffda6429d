"""Near-duplicate classes by ProbMinHash over weighted five-word shingles.

1. Equal texts become one class (128 bits of SHA-256).
2. Each class gets a ProbMinHash signature: every shingle of weight w is a Poisson process of rate w,
   each arrival falls into a random register, a register keeps the shingle of its earliest arrival, and
   a shingle stops once its next arrival is later than every register. Two registers agree with the
   probability Jaccard J_P of the weighted sets.
3. ROWS registers make a band, BANDS bands a document: a pair with J_P = 0.8 meets with probability
   1 - (1 - 0.8**7)**40 = 0.9999.
4. In each bucket the class that shares buckets most is the centre; the rest are compared with it
   exactly (J_P of whole texts). Where a bucket still holds several components, all pairs across them are
   compared: as rows in small buckets, in blocks of members in large ones, where only links leave the
   task. So no link that banding found is lost; pairs inside one component cannot change it.
5. Connected components of the verified links are the classes.

The weight of a shingle that occurs n times is 1 + log2(n).

Defined cases: null counts as empty; empty texts form one class and resemble nothing else; texts of
one to four words are one shingle; repeated rows and repeated doc_ids stay, each with the class of its
text; a class id is the least doc_id of the class (null if it has none). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import shingles as S
from .common import cut, packed, slices, small_batches, text_or_empty

ROWS, BANDS = 7, 40
THRESHOLD = 0.8
#: Sums of floats may fall short of a similarity of exactly THRESHOLD by this.
ROUNDING = 1e-9
#: Buckets of more members are compared block by block, BLOCK members at a time.
SMALL, BLOCK = 24, 512
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def weighted(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their weights: row, hash (ascending in a row), weight."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    return row[first], hashes[first], 1.0 + np.log2(count)


def signatures(row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, rows: int, m: int = ROWS * BANDS) -> np.ndarray:
    """ProbMinHash registers (the winning shingle's hash) of ``rows`` weighted sets."""
    earliest = np.full(rows * m, np.inf)
    winner = np.zeros(rows * m, _U)
    bound = np.full(rows, np.inf)
    time = np.zeros(len(row))
    step = 0
    while len(row):
        t = int(min(64, max(1, 20_000 // len(row)))) if step else 1
        ticks = (np.arange(step, step + t, dtype=_U) * _U(2) + _U(1)) * _STEP
        u = S.mix(hashes[:, None] + ticks[None, :])
        gaps = -np.log(((u >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[:, None]
        at = time[:, None] + np.cumsum(gaps, axis=1)
        live = at < bound[row][:, None]
        who, _ = np.nonzero(live)
        slot = row[who] * m + (S.mix(u[live] ^ _STEP) % _U(m)).astype(np.int64)
        when = at[live]
        np.minimum.at(earliest, slot, when)
        won = earliest[slot] == when
        winner[slot[won]] = hashes[who[won]]
        bound = earliest.reshape(rows, m).max(axis=1)
        time = at[:, -1]
        on = time < bound[row]
        row, hashes, weight, time = row[on], hashes[on], weight[on], time[on]
        step += t
    return winner.reshape(rows, m)


_PLACE = S.mix(np.arange(1, ROWS * BANDS + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the key depends on the band's number."""
    return S.mix((signature * _PLACE).reshape(len(signature), BANDS, ROWS).sum(axis=2, dtype=_U)).view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two weighted sets: ascending hashes and weights."""
    if not len(a) or not len(b):
        return 0.0
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    above = only_x + x.sum() - np.cumsum(x)  # x of elements whose ratio is larger, by place
    below = only_y + np.cumsum(y)
    last = np.searchsorted(ratio, ratio, side="right") - 1  # equal ratios count alike
    return float((1.0 / (above[last] / x + below[last] / y)).sum())


def _keys(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digest = [hashlib.sha256(t.as_buffer() if hasattr(t, "as_buffer") and t.is_valid else b"").digest()[:16] for t in b.column(1).cast(pa.large_binary())]
            keys, filled = [], []
            for _, hashes, at in S.shingle_rows(b.column(1)):
                n = len(at) - 1
                keys.append(band_keys(signatures(*weighted(hashes, at), n)))
                filled.append(np.diff(at) > 0)
            keys = np.concatenate(keys) if keys else np.zeros((0, BANDS), np.int64)
            filled = np.concatenate(filled) if filled else np.zeros(0, bool)
            at = np.zeros(len(filled) + 1, np.int32)
            np.cumsum(filled * BANDS, out=at[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[filled].ravel()))], ["doc_id", "same", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, same binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose texts have J_P of at least THRESHOLD, with it.

    a occurs in few pairs and is joined first; b may be the centre of very many, and that join splits
    its large partitions. In a task equal centres stand together, so their shingles are made once.
    """
    with_a = pairs.join(texts.select(F.col("same").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("same").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)
        for batch in slices(batches):
            left, right = S.strings(batch.column(2)), batch.column(1).to_pylist()
            near = np.zeros(len(left))
            for lo, hashes, at in S.shingle_rows(left):
                n = len(at) - 1
                row, h, w = weighted(hashes, at)
                place = np.searchsorted(row, np.arange(n + 1))
                for i in range(n):
                    if right[lo + i] != last[0]:
                        ((_, hb, atb),) = S.shingle_rows(batch.column(3).slice(lo + i, 1))
                        last = (right[lo + i], *weighted(hb, atb)[1:])
                    near[lo + i] = probability_jaccard(h[place[i] : place[i + 1]], w[place[i] : place[i + 1]], last[1], last[2])
            keep = pa.array(near >= THRESHOLD - ROUNDING)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(near).filter(keep)], ["a", "b", "near"])

    return with_b.mapInArrow(run, "a binary, b binary, near double")


def _meet(keys: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the rows ``left`` and ``right`` have a bucket in common."""
    sizes = np.diff(keys.offsets.to_numpy())
    row, term = np.repeat(np.arange(len(sizes)), sizes), np.unique(keys.flatten().to_numpy(), return_inverse=True)[1]
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, int(term[-1]) + 1 if len(term) else 0, 2048):
        a, b = np.searchsorted(term, (lo, lo + 2048))
        has = np.zeros((len(sizes), 2048), np.float32)
        has[row[a:b], term[a:b] - lo] = 1
        out |= has[left] @ has[right].T > 0
    return out


def block_links(names: list, roots: list, keys: pa.ListArray, texts: pa.Array, left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """Links between the rows ``left`` and ``right`` of one block pair that share a bucket and lie in different components.

    With X and Y the weights of the common shingles in both texts, J_P <= 1 / (W_x / X + W_y / Y - 1);
    the products of the weight matrices give X and Y of all pairs, and J_P is computed where the bound allows.
    """
    row, hashes, weight = [], [], []
    for lo, h, at in S.shingle_rows(texts):
        r, h, w = weighted(h, at)
        row.append(r + lo)
        hashes.append(h)
        weight.append(w)
    row, hashes, weight = np.concatenate(row), np.concatenate(hashes), np.concatenate(weight)
    place = np.searchsorted(row, np.arange(len(names) + 1))
    total = np.add.reduceat(np.append(weight, 0.0), place[:-1])
    total[place[:-1] == place[1:]] = 0
    _, term, seen = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = seen[term] > 1
    r, w = row[shared], weight[shared]
    _, t = np.unique(term[shared], return_inverse=True)
    order = np.argsort(t, kind="stable")
    r, w, t = r[order], w[order], t[order]
    n = len(names)
    x, y = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    terms = int(t[-1]) + 1 if len(t) else 0
    for lo in range(0, terms, 2048):
        a, b = np.searchsorted(t, (lo, lo + 2048))
        full = np.zeros((n, min(2048, terms - lo)), np.float32)
        full[r[a:b], t[a:b] - lo] = w[a:b]
        has = (full > 0).astype(np.float32)
        x += full[left] @ has[right].T
        y += has[left] @ full[right].T
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = 1.0 / (total[left][:, None] / x + total[right][None, :] / y - 1.0)
    code = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]
    fit = _meet(keys, left, right) & (x > 0) & (bound >= THRESHOLD - 1e-4) & (code[left][:, None] != code[right][None, :])
    out = []
    for i, j in np.argwhere(fit):
        i, j = left[i], right[j]
        near = probability_jaccard(hashes[place[i] : place[i + 1]], weight[place[i] : place[i + 1]], hashes[place[j] : place[j + 1]], weight[place[j] : place[j + 1]])
        if near >= THRESHOLD - ROUNDING:
            out.append((names[i], names[j], near))
    return out


def _in_blocks(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among members that large buckets hold: groups of such buckets, every block with every other.

    A pair is compared where it shares a bucket, as in small buckets, and once, however many it shares.
    """
    hub = rest.groupBy("key").agg(F.min("same").alias("hub"))
    groups = connected_components(rest.join(hub, "key").select("same", "hub"), "same", "hub")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    roots = rest.groupBy("same").agg(F.min("root").alias("part"), F.collect_set("key").alias("keys"))  # at most BANDS of them
    dealt = groups.join(sizes, "root").withColumnRenamed("node", "same").withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    dealt = dealt.join(roots, "same").join(texts, "same")
    dealt = dealt.select("root", "same", "part", "keys", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("root", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "same", "part", "keys", "text", "block")

    def run(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        block = group.column("block").to_numpy()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        rows = block_links(group.column("same").to_pylist(), group.column("part").to_pylist(), group.column("keys").combine_chunks(), S.strings(group.column("text")), left, right)
        return pa.table({"a": pa.array([r[0] for r in rows], pa.binary()), "b": pa.array([r[1] for r in rows], pa.binary()), "near": pa.array([r[2] for r in rows], pa.float64())})

    return dealt.groupBy("root", "lo", "hi").applyInArrow(run, "a binary, b binary, near double")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and text digest ``same`` of every row; root and copies_id of every digest."""
    small_batches(docs.sparkSession)
    keys = cut(_keys(docs))
    classes = cut(keys.groupBy("same").agg(F.min("doc_id").alias("copies_id"), F.first("bands").alias("bands")))
    entries = classes.select("same", F.explode("bands").alias("key"))
    # what joins a bucket's members is a table of its own, so adaptive execution can split a large bucket in the join
    sizes = cut(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(entries.join(sizes.hint("merge"), "key").select("key", "same", "n"))
    weight = shared.groupBy("same").agg(F.sum("n").alias("degree"))
    members = cut(shared.join(weight, "same").select("key", "same", "degree"))
    centres = cut(members.groupBy("key").agg(F.max(F.struct("degree", "same")).getField("same").alias("centre")))
    star = cut(members.join(centres.hint("merge"), "key").where("same <> centre").select(F.col("same").alias("a"), F.col("centre").alias("b")).distinct())
    # one row for each class that shares a bucket; joined on the text and the id, so copies do not meet in one task
    involved = members.select("same").distinct().join(classes, "same").select("same", "copies_id")
    texts = docs.select(F.unhex(F.substring(F.sha2(text_or_empty(), 256), 1, 32)).alias("same"), F.col("doc_id").cast("long").alias("__id"), text_or_empty().alias("text"))
    texts = texts.join(involved.withColumnRenamed("same", "__same"), F.col("same").eqNullSafe(F.col("__same")) & F.col("__id").eqNullSafe(F.col("copies_id")), "left_semi")
    texts = cut(texts.groupBy("same").agg(F.first("text").alias("text")))
    links = cut(_verified(star, texts))
    parts = connected_components(links)

    # Buckets that still hold several components: every pair across components is compared.
    labelled = members.join(parts.withColumnRenamed("node", "same"), "same", "left").select("key", "same", F.coalesce("root", "same").alias("root"))
    labelled = cut(labelled)
    split = cut(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"))
    rest = cut(labelled.join(split.hint("merge"), "key"))
    few = rest.where(F.col("n") <= SMALL)
    other = few.select("key", F.col("same").alias("b"), F.col("root").alias("root_b"))
    pairs = few.select("key", F.col("same").alias("a"), "root").join(other, "key").where("a < b and root <> root_b").select("a", "b").distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(_verified(pairs.join(tried, ["a", "b"], "left_anti"), texts).unionAll(_in_blocks(rest.where(F.col("n") > SMALL), texts)))
    if more.limit(1).count():
        # only the components that the new links join are relabelled
        roots = rest.select("same", "root").distinct()
        ends = more.join(roots.select(F.col("same").alias("a"), F.col("root").alias("root_a")), "a").join(roots.select(F.col("same").alias("b"), F.col("root").alias("root_b")), "b")
        joined = connected_components(ends.select("root_a", "root_b"), "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("to"))
        old = parts.unionAll(joined.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))
        parts = cut(old.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")))

    roots = classes.select("same", "copies_id").join(parts.withColumnRenamed("node", "same"), "same", "left").select("same", "copies_id", F.coalesce("root", "same").alias("root"))
    return keys, cut(roots)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copies_id (least doc_id with the same text) of every row, and whether it is the class's first."""
    keys, roots = _classes(docs)
    least = roots.groupBy("root").agg(F.min("copies_id").alias("class_id"))
    named = roots.join(least, "root")
    return keys.select("doc_id", "same").join(named, "same").select("doc_id", "class_id", "copies_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: of the least doc_id (null last), of several texts under it the least digest.

    Of rows equal in both the one stays whose other columns come first as JSON.
    """
    _, roots = _classes(docs)
    kept = roots.groupBy("root").agg(F.min(F.struct(F.col("copies_id").isNull(), "copies_id", "same")).alias("kept"))
    kept = kept.select(F.col("kept.copies_id").alias("kept_id"), F.col("kept.same").alias("kept_same"))
    others = F.to_json(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.substring(F.sha2(text_or_empty(), 256), 1, 32)).alias("same"), others.alias("others"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("same") == F.col("kept_same")), "left_semi")
    return rows.groupBy("id", "same").agg(F.min_by("row", "others").alias("row")).select("row.*")
