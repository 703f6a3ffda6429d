"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents counts in how many passages (48 words) each hashed word occurs, and writes
   the word counts of every passage to the shared folder.
2. A randomised SVD of the TF-IDF matrix of all of these and the benchmark's passages gives the latent
   space: products with the matrix are made by tasks over its rows and summed by Spark, block by block of
   words; the driver orthonormalises.
3. A second pass embeds windows of every document (12, 24 and 48 words, half overlapping; sums of word
   vectors) and compares them by cosine with every benchmark passage of about that length: a word vector
   table of fixed size and the benchmark (in blocks of at most BLOCK passages) are what a task holds.
   Runs of RUN words (SHORT_RUN for passages of up to 18 words) that a text shares with a passage are
   candidates too, whatever the cosine, so a verbatim passage is always found; passages of fewer than
   MIN_WORDS words are looked up as whole runs.
4. Each candidate is checked exactly: the longest common subsequence of words of the passage and the
   window's surroundings must cover LCS_SHARE of the passage, and the passage's rarest words, its answer,
   must be among them by ANSWER_SHARE. So passages with words changed, dropped or put in are found too.
   The answers of all candidates of a slice by cosine are looked up at once, before the subsequence.

Words are runs of letters and digits in lower case; in scripts without blanks each character is a word. Benchmark items of over 48 words are searched by
pieces of at most 48 words; a document leaks an item if it has one of its pieces.

Defined cases: null texts count as empty and match nothing; items of fewer than MIN_WORDS words are
searched verbatim only, items without words never; items of null id are searched like others and count as one item; repeated documents or items give repeated rows once each; an empty benchmark or table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import SLICE_ROWS, cut, slices, small_batches, text_or_empty

BUCKETS = 1 << 16
RANK = 48
#: Passages in a row of the matrix's table, which are multiplied at once (a slice of all, none is left out), and those of one task.
SAMPLE, TASK_PASSAGES = 64, 131_072
#: Words whose rows of a product are summed together.
WORD_BLOCK = 128
STEP, SHORT, LONG = 12, 24, 48
MIN_WORDS = 6
RUN, SHORT_RUN = 4, 3
COSINE = 0.5
LCS_SHARE, ANSWER_SHARE = 0.65, 0.6
#: Pieces that one pass over the documents looks for; an index of so many has about 50 MB and is what is broadcast.
BLOCK = 32_768
#: Cosines that are worked out at once, of some windows with all pieces.
COSINES = 1 << 20
#: Pieces that a worker keeps ready for the exact check.
READY = 4_096
#: Directions of a singular value below this share of the largest are left out.
LEAST_VALUE = 1e-3

#: Runs that more pieces share are looked up only for a piece to whose RAREST runs they belong.
FEW, RAREST = 32, 8
#: Stands for the null item_id while pieces are searched; items of null id count as one.
NO_ID = -(1 << 63)

#: Slots of the table that tells which run hashes cannot be in a block.
SLOTS = 22
#: Chinese, Japanese, Thai, Lao, Tibetan, Burmese, Khmer, with the punctuation and full-width forms used there.
UNSPACED = r"([\x{0E00}-\x{109F}\x{1780}-\x{17FF}\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}])"

_U = np.uint64
_RUN_PLACE = S.mix(np.arange(1, 7, dtype=_U) * _U(0x8CB92BA72F3D8DD7)) | _U(1)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; the last places have none."""
    out = np.zeros(max(0, len(hashes) - n + 1), _U)
    for k in range(n):
        out += hashes[k : k + len(out)] * _RUN_PLACE[k]
    return S.mix(out + _U(n))


def folded_words(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice: first row, word hashes, places of rows' first words."""
    text = pc.utf8_lower(S.strings(column))
    data = text.buffers()[2]
    if data is not None and data.size and (np.frombuffer(data, np.uint8) >= 0xE0).any():  # beyond two-byte characters
        text = pc.replace_substring_regex(text, UNSPACED, r" \1 ")
    for row, data, offsets in S.chunks(text):
        hashes, _, _, at = S.words(data, offsets, folded=True)
        yield row, hashes, at


def _take(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``a[at]`` along the first axis, which is much slower for rows of a wide table; places beyond the end take the last."""
    return a.take(at, axis=0, mode="clip")


def _slots(keys: np.ndarray) -> np.ndarray:
    """A bit for each of 1 << SLOTS slots: whether a key begins so."""
    seen = np.zeros(1 << SLOTS, bool)
    seen[keys >> _U(64 - SLOTS)] = True
    return np.packbits(seen, bitorder="little")


def _seen(slots: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be among the keys of the slots."""
    slot = (hashes >> _U(64 - SLOTS)).astype(np.int64)
    return np.flatnonzero(_take(slots, slot >> 3) >> (slot & 7).astype(np.uint8) & 1)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(48)).astype(np.int64)


def _blocks(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of ``size`` words in each row, and the row of each."""
    count = np.diff(at)
    per = -(-count // size)
    row = np.repeat(np.arange(len(count)), per)
    first = np.cumsum(per) - per
    return at[row] + size * (np.arange(len(row)) - first[row]), row


def _packed(bucket: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each passage in ascending order, how often each occurs there, and how many each passage has."""
    key = np.sort(passage << 16 | bucket)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return key[first].astype(np.uint16), np.diff(np.append(first, len(key))).astype(np.uint8), np.bincount(key[first] >> 16)


def _rows(words: np.ndarray, times: np.ndarray, sizes: np.ndarray, every: int) -> list[tuple[bytes, bytes, bytes]]:
    """The packed passages in rows of ``every``."""
    ends = np.append(0, np.cumsum(sizes))
    out = []
    for lo in range(0, len(sizes), every):
        hi = min(lo + every, len(sizes))
        out.append((words[ends[lo] : ends[hi]].tobytes(), times[ends[lo] : ends[hi]].tobytes(), sizes[lo:hi].astype(np.uint8).tobytes()))
    return out


#: Words, how often each occurs and words by passage, packed.
PASSAGE = "passage binary, times binary, sizes binary"


def count_passages(docs: DataFrame) -> tuple[np.ndarray, int, DataFrame]:
    """Passages by hashed word, number of passages, and the word counts of all passages, SAMPLE in a row."""

    def made_of(words, counts, packed) -> pa.RecordBatch:
        kinds = {"word": pa.int32(), "n": pa.int64(), "passage": pa.binary(), "times": pa.binary(), "sizes": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(counts, pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in slices(batches):
            for _, hashes, at in folded_words(b.column(0)):
                if not len(hashes):
                    continue
                starts, _ = _blocks(at, LONG)
                passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
                packed = _packed(_bucket(hashes), passage)
                df += np.bincount(packed[0], minlength=BUCKETS)
                n += len(starts)
                rows = _rows(*packed, SAMPLE)
                yield made_of([-2] * len(rows), [None] * len(rows), zip(*rows, strict=True))
        some = np.flatnonzero(df)
        rows = 1 + len(some)
        yield made_of(np.append(-1, some).astype(np.int32), np.append(n, df[some]), [[None] * rows] * 3)

    made = cut(docs.select(text_or_empty().alias("text")).mapInArrow(run, f"word int, n long, {PASSAGE}"))
    df, total = np.zeros(BUCKETS), 0
    for r in made.where("word >= -1").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS + 1 rows
        if r["word"] < 0:
            total = r["n"]
        else:
            df[r["word"]] = r["n"]
    return df, total, made.where("word = -2").select("passage", "times", "sizes")


def _product(words: np.ndarray, times: np.ndarray, sizes: np.ndarray, q: np.ndarray, weight: np.ndarray, out: np.ndarray, column: np.ndarray) -> None:
    """Adds A'Aq to ``out``, A being the normed TF-IDF rows of some packed passages; ``column`` has room for a number for each bucket."""
    at = np.cumsum(sizes) - sizes
    value = times * _take(weight, words)
    value /= np.repeat(np.maximum(np.sqrt(np.add.reduceat(value * value, at)), 1e-9), sizes)
    word = np.sort(words)
    word = word[np.append(True, word[1:] != word[:-1])]
    column[word] = np.arange(len(word))
    rows = np.zeros((len(sizes), len(word)), np.float32)
    rows.reshape(-1)[np.repeat(np.arange(len(sizes)) * len(word), sizes) + _take(column, words)] = value
    part = rows.T @ (rows @ _take(q, word))
    part += _take(out, word)
    out[word] = part


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b in double precision, by slices."""
    out = np.zeros((a.shape[1], b.shape[1]))
    for lo in range(0, len(a), 4_096):
        out += a[lo : lo + 4_096].T.astype(np.float64) @ b[lo : lo + 4_096].astype(np.float64)
    return out


def _turned(a: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """``a`` times ``turn``, by slices, so no copy in double precision stands beside it."""
    out = np.empty((len(a), turn.shape[1]), np.float32)
    for lo in range(0, len(a), 4_096):
        out[lo : lo + 4_096] = a[lo : lo + 4_096].astype(np.float64) @ turn
    return out


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``z``; directions that it lacks become zero."""
    for _ in range(2):  # the second time mends what rounding left
        size, turn = np.linalg.eigh(_gram(z, z))
        there = size > 1e-13 * max(float(size[-1]), 1e-300)
        z = _turned(z, turn * np.where(there, 1.0 / np.sqrt(np.where(there, size, 1.0)), 0.0))
    return z


def randomised_svd(passages: DataFrame, idf: np.ndarray, tasks: int, rank: int = RANK, extra: int = 8, rounds: int = 2, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of the TF-IDF matrix with a row for each packed passage.

    A round multiplies A'A with the current basis. Each of at most ``tasks`` tasks sums over its rows, and blocks of
    WORD_BLOCK words are summed over the tasks; what meets at the driver is one BUCKETS x (rank + extra) matrix.
    """
    spark, size = passages.sparkSession, rank + extra
    rows = passages.coalesce(tasks)
    basis = np.random.default_rng(seed).standard_normal((BUCKETS, size), dtype=np.float32)
    for turn_no in range(rounds):
        shared = spark.sparkContext.broadcast((basis, idf.astype(np.float32)))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, weight = shared.value
            out, column = np.zeros((BUCKETS, size), np.float32), np.zeros(BUCKETS, np.int64)
            for b in batches:
                for words, times, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    _product(np.frombuffer(words, np.uint16), np.frombuffer(times, np.uint8).astype(np.float32), np.frombuffer(sizes, np.uint8).astype(np.int64), q, weight, out, column)
            blocks = out.reshape(-1, WORD_BLOCK * size)
            some = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([int(TaskContext.get().partitionId())] * len(some), pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "task", "part"])

        def total(group: pa.Table) -> pa.Table:
            group = group.sort_by("task")  # sums of floats depend on their order
            out = np.zeros(WORD_BLOCK * size)
            for part in group.column("part"):
                out += np.frombuffer(part.as_buffer(), np.float32)
            return pa.table({"block": group.column("block").slice(0, 1), "part": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

        z = np.zeros((BUCKETS // WORD_BLOCK, WORD_BLOCK * size), np.float32)
        for r in rows.mapInArrow(multiply, "block int, task int, part binary").groupBy("block").applyInArrow(total, "block int, part binary").toLocalIterator():
            z[r["block"]] = np.frombuffer(r["part"], np.float32)
        z = z.reshape(BUCKETS, size)
        shared.destroy()
        small, last = _gram(basis, z), basis
        basis = _orthonormal(z) if turn_no < rounds - 1 else None
    # Rayleigh-Ritz on the basis that the last product was made with
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    return _turned(last, turn[:, best]), np.sqrt(np.maximum(values[best], 1e-12))


def _rare(key: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Runs worth looking up: those of few pieces, and each piece's rarest. So a phrase that a whole benchmark shares does not lead to all of it."""
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    counts = counts[back]
    order = np.lexsort((counts, piece))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.searchsorted(piece[order], piece[order])
    return (counts <= FEW) | (rank < RAREST)


class Index:
    """Benchmark passages in the latent space, and what is needed to search and check a text."""

    def __init__(self, words: np.ndarray, idf: np.ndarray, pieces: list[tuple[int, np.ndarray]]):
        self.words, self.idf = words, idf
        self.items = np.array([i for i, _ in pieces], np.int64)
        self.hashes = np.concatenate([np.zeros(0, _U), *(h for _, h in pieces)])
        length = np.array([len(h) for _, h in pieces])
        self.at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        self._ready: dict[int, tuple[dict[int, int], frozenset]] = {}
        answers = [self._answer(h) for _, h in pieces]
        self.need = np.array([ANSWER_SHARE * len(a) for a in answers])
        # the words of all answers, and for each piece the places of its own there
        self.rare, of = np.unique(np.concatenate([np.zeros(0, _U), *answers]), return_inverse=True)
        self.answer_at = np.concatenate([[0], np.cumsum([len(a) for a in answers])]).astype(np.int64)
        self.answer = of.astype(np.int32)
        self.rare_slots = _slots(self.rare)
        q = np.add.reduceat(words[_bucket(self.hashes)], self.at[:-1], axis=0)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        self.q = q
        # step, blocks, every how many blocks a window starts, pieces
        gated = [
            (STEP // 2, 2, 1, (length >= MIN_WORDS) & (length <= STEP + STEP // 2)),
            (STEP, SHORT // STEP, 1, (length > STEP) & (length <= SHORT + STEP // 2)),
            (STEP, LONG // STEP, 2, length > SHORT + STEP // 2),
        ]
        self.gates = [(step, blocks, every, np.flatnonzero(which), np.ascontiguousarray(q[which].T)) for step, blocks, every, which in gated if which.any()]
        self.runs = []
        near = (length >= MIN_WORDS) & (length <= STEP + STEP // 2)
        kinds = [(n, True, length == n) for n in range(1, MIN_WORDS)] + [(SHORT_RUN, False, near), (RUN, False, length > STEP + STEP // 2)]
        for n, whole, which in kinds:
            which = np.flatnonzero(which)
            if not len(which):
                continue
            made = [_runs(pieces[i][1], n) for i in which]
            key = np.concatenate(made)
            piece = np.repeat(which, [len(m) for m in made]).astype(np.int32)
            place = np.concatenate([np.arange(len(m)) for m in made]).astype(np.int32)
            if not whole:
                keep = _rare(key, piece)
                key, piece, place = key[keep], piece[keep], place[keep]
            order = np.argsort(key, kind="stable")
            self.runs.append((n, whole, key[order], piece[order], place[order], _slots(key)))

    def piece(self, i: int) -> np.ndarray:
        """Word hashes of a piece."""
        return self.hashes[self.at[i] : self.at[i + 1]]

    def _answer(self, h: np.ndarray) -> np.ndarray:
        """The words of a piece's answer: the rarest quarter, two at least."""
        rare = np.unique(h)
        return rare[np.argsort(-self.idf[_bucket(rare)], kind="stable")][: max(2, len(rare) // 4)]

    def ready(self, i: int) -> tuple[dict[int, int], frozenset]:
        """Places of each word of a piece, as bits, and the words of its answer."""
        if i not in self._ready:
            if len(self._ready) >= READY:
                self._ready.clear()
            h = self.piece(i)
            places: dict[int, int] = {}
            for k, w in enumerate(h.tolist()):
                places[w] = places.get(w, 0) | 1 << k
            self._ready[i] = (places, frozenset(self.rare[self.answer[self.answer_at[i] : self.answer_at[i + 1]]].tolist()))
        return self._ready[i]

    def search(self, column) -> list[list[tuple[int, float, float]]]:
        """For each text: (item, cosine, share of the passage in the common subsequence) of its leaks, by item."""
        out: list[list[tuple[int, float, float]]] = []
        for _, hashes, at in folded_words(column):
            found: list[dict[int, tuple[float, float]]] = [{} for _ in range(len(at) - 1)]
            if len(hashes) and len(self.items):
                self._windows(hashes, at, found)
                self._shared_runs(hashes, at, found)
            out += [sorted((i, *v) for i, v in f.items()) for f in found]
        return out

    def _sums(self, hashes: np.ndarray, at: np.ndarray, step: int, half: tuple | None) -> np.ndarray:
        """Sum of the word vectors of each block; from those of blocks of half the size, if they are there."""
        starts, row = _blocks(at, step)
        if half is None:
            bucket = _bucket(hashes)
            out = _take(self.words, _take(bucket, starts + 1))
            for k in (*range(2, step), 0):
                out += _take(self.words, _take(bucket, starts + k))
            size = np.diff(np.append(starts, len(hashes)))
            short = np.flatnonzero(size < step)  # last ones of their rows
            if len(short):
                size = size[short]
                first = np.cumsum(size) - size
                word = np.arange(size.sum()) + np.repeat(starts[short] - first, size)
                out[short] = np.add.reduceat(_take(self.words, bucket[word]), first, axis=0)
            return out
        finer, _, sums = half
        place = np.searchsorted(finer, starts)
        out = _take(sums, place)
        two = np.append(place[1:], len(finer)) - place > 1
        out[two] += sums[place[two] + 1]
        return out

    def _windows(self, hashes: np.ndarray, at: np.ndarray, found: list[dict]) -> None:
        made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rare = self._rare_places(hashes)
        for step, blocks, every, which, q in self.gates:
            if step not in made:
                half = made.get(step // 2)
                starts, row = _blocks(at, step)
                # a row of zeros behind them stands for blocks beyond a text's end
                made[step] = (starts, row, np.append(self._sums(hashes, at, step, half), np.zeros((1, self.words.shape[1]), np.float32), axis=0))
            starts, row, sums = made[step]
            last = np.searchsorted(row, np.arange(len(at) - 1), side="right")[row] - 1  # each row's last block
            first = np.arange(len(starts))
            if every > 1:
                first = first[(first - np.searchsorted(row, row)) % every == 0]
            w = _take(sums, first)
            for k in range(1, blocks):
                w += _take(sums, np.where(first + k <= last[first], first + k, len(starts)))
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-9)
            some = max(1, COSINES // len(which))
            for lo in range(0, len(w), some):
                cos = w[lo : lo + some] @ q
                i, j = np.divmod(np.flatnonzero(cos >= COSINE * norm[lo : lo + some, None]), cos.shape[1])
                block = first[lo + i]
                keep = self._answered(rare, at, starts[block], row[block], blocks * step, which[j])
                for b, x, y in zip(block[keep].tolist(), i[keep].tolist(), j[keep].tolist(), strict=True):
                    self._check(hashes, at, int(starts[b]), int(row[b]), blocks * step, int(which[y]), float(cos[x, y] / norm[lo + x]), found)

    def _rare_places(self, hashes: np.ndarray) -> np.ndarray:
        """Word of an answer (its place among them) and place in the texts, as one number, of each of these words there; ascending."""
        place = _seen(self.rare_slots, hashes)
        word = np.minimum(np.searchsorted(self.rare, hashes[place]), len(self.rare) - 1)
        there = self.rare[word] == hashes[place]
        return np.sort(word[there] << 40 | place[there])

    def _answered(self, rare: np.ndarray, at: np.ndarray, start: np.ndarray, row: np.ndarray, size: int, piece: np.ndarray) -> np.ndarray:
        """Candidates with as many words of the piece's answer around the window as ``_check`` asks for."""
        n = self.at[piece + 1] - self.at[piece]
        begin, end = np.maximum(at[row], start - n), np.minimum(at[row + 1], start + size + n)
        kept = []
        for lo in range(0, len(piece), 16_384):
            p = piece[lo : lo + 16_384]
            words = self.answer_at[p + 1] - self.answer_at[p]
            of = np.repeat(np.arange(len(p)), words)
            word = self.answer[np.arange(len(of)) + np.repeat(self.answer_at[p] - (np.cumsum(words) - words), words)].astype(np.int64) << 40
            # the word's first place from the beginning on
            next_ = np.append(rare, 1 << 62)[np.searchsorted(rare, word | begin[lo + of])]
            there = np.bincount(of[next_ < (word | end[lo + of])], minlength=len(p))
            kept.append(lo + np.flatnonzero(there >= self.need[p]))
        return np.concatenate([np.zeros(0, np.int64), *kept])

    def _shared_runs(self, hashes: np.ndarray, at: np.ndarray, found: list[dict]) -> None:
        """Candidates that share a run of words with a passage, laid along the passage."""
        for n, whole, key, piece, place, seen in self.runs:
            run = _runs(hashes, n)
            start = _seen(seen, run)
            lo, hi = np.searchsorted(key, run[start], side="left"), np.searchsorted(key, run[start], side="right")
            start, lo, hi = start[hi > lo], lo[hi > lo], hi[hi > lo]
            row = np.searchsorted(at, start, side="right") - 1
            inside = start + n <= at[row + 1]
            start, lo, hi, row = start[inside], lo[inside], hi[inside], row[inside]
            tried: set[tuple[int, int, int]] = set()
            for s, a, b, r in zip(start.tolist(), lo.tolist(), hi.tolist(), row.tolist(), strict=True):
                for k in range(a, b):
                    p, begin = int(piece[k]), s - int(place[k])
                    if (r, p, begin) in tried:
                        continue
                    tried.add((r, p, begin))
                    best = found[r].get(int(self.items[p]))
                    if best and best[1] >= 0.999:
                        continue
                    size = int(self.at[p + 1] - self.at[p])
                    begin = max(begin, int(at[r]))
                    w = self.words[_bucket(hashes[begin : min(begin + size, int(at[r + 1]))])].sum(axis=0)
                    cosine = float(w @ self.q[p] / max(float(np.linalg.norm(w)), 1e-9))
                    if whole:
                        found[r][int(self.items[p])] = (cosine, 1.0)
                    else:
                        self._check(hashes, at, begin, r, size, p, cosine, found)

    def _check(self, hashes, at, start, row, size, piece, cosine, found) -> None:
        item, n = int(self.items[piece]), int(self.at[piece + 1] - self.at[piece])
        best = found[row].get(item)
        if best and best[1] >= 0.999:
            return
        lo, hi = max(int(at[row]), int(start) - n), min(int(at[row + 1]), int(start) + size + n)
        near = hashes[lo:hi].tolist()
        bits, answer = self.ready(piece)
        if len(answer.intersection(near)) < ANSWER_SHARE * len(answer):
            return
        every = v = (1 << n) - 1
        for w in near:
            m = bits.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & every
        share = (n - v.bit_count()) / n
        if share >= LCS_SHARE and (best is None or best[1] < share):
            found[row][item] = (cosine, share)


def benchmark_pieces(benchmark: DataFrame) -> DataFrame:
    """item_id, text, place, word hashes and packed word counts of every piece of at most LONG words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for row, hashes, at in folded_words(b.column(1)):
                for i in range(len(at) - 1):
                    n = int(at[i + 1] - at[i])
                    if n:
                        rows += [(ids[row + i], texts[row + i], k, p.tobytes(), *_rows(*_packed(_bucket(p), np.zeros(len(p), np.int64)), 1)[0]) for k, p in enumerate(np.array_split(hashes[at[i] : at[i + 1]], -(-n // LONG)))]
            kinds = {"item_id": pa.int64(), "text": pa.string(), "place": pa.int32(), "words": pa.binary(), "passage": pa.binary(), "times": pa.binary(), "sizes": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"item_id long, text string, place int, words binary, {PASSAGE}")


def build(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """Search structures for blocks of the benchmark's passages, fitted on the corpus's counts."""
    spark = docs.sparkSession
    small_batches(spark)
    df, n, passages = count_passages(docs)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + 1e-3
    made = cut(benchmark_pieces(benchmark))
    if not n or not made.limit(1).count():
        return
    words, values = randomised_svd(passages.unionAll(made.select("passage", "times", "sizes")), idf, max(spark.sparkContext.defaultParallelism, -(-n // TASK_PASSAGES)))
    words *= np.where(values > LEAST_VALUE * values.max(), 1.0 / np.maximum(values, 1e-12), 0.0).astype(np.float32)
    words *= idf[:, None]
    pieces = ((r["item_id"], np.frombuffer(r["words"], _U)) for r in made.orderBy("item_id", "text", "place").select("item_id", "words").toLocalIterator())
    while some := list(islice(pieces, BLOCK)):
        yield Index(words, idf, some)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine and lcs_share of every benchmark item that a document has."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs_share double"
    out = None
    for index in build(docs, benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = [(d, *x) for d, found in zip(b.column(0).to_pylist(), shared.value.search(b.column(1)), strict=True) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())], ["doc_id", "item_id", "cosine", "lcs_share"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], schema)
    out = out.withColumn("item_id", F.nullif("item_id", F.lit(NO_ID)))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))


def _is_clean(shared):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        parts = (texts.iloc[lo : lo + SLICE_ROWS] for lo in range(0, len(texts), SLICE_ROWS))
        return pd.Series([not f for p in parts for f in shared.value.search(pa.array(p, pa.string(), from_pandas=True))], dtype=bool)

    return clean


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak a benchmark item."""
    spark = docs.sparkSession
    keep = [F.col(f"`{c}`") for c in docs.columns]
    out = docs
    for index in build(docs, benchmark):
        clean = _is_clean(spark.sparkContext.broadcast(index))
        out = out.where(clean(F.col("text").cast("string"))).select(*keep)
    return out
