"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair made of the live part that starts at byte i and its
right neighbour (or "no pair"). Each inner node holds the smallest rank below it, with its place, so the
root is the leftmost pair of least rank. A merge drops one part and changes the leaves of two live
neighbours: O(log n) each, O(n log n) for a piece, whatever its length.

The distinct new pieces of a group of texts are merged together: those of one padded size are the rows of
one array that holds their trees, and each step does the next merge of every row. Pieces of over
TOGETHER bytes, and sizes with few rows, have a tree of their own. A pair of parts is looked up by its
two ids; the table of pairs holds every way to split a vocabulary entry into two others.

The rank file is read once, by the driver, and broadcast (a vocabulary of 200,000 entries has 4 MB).

Defined cases: a null text counts as empty and has no tokens; ids_sha256 is then the digest of the
empty string. Special tokens are ordinary text. A very long text is worked on in portions of PORTION
pieces. Repeated rows stay; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty

#: Pieces, and ids of pieces, that a task remembers; the memo starts anew beyond either.
MEMO, MEMO_IDS = 200_000, 2_000_000
#: Texts of up to so many characters in all are worked on at once; a longer one goes by portions of so many pieces.
GROUP, PORTION = 1 << 20, 1 << 18
#: Longest piece, in bytes, whose tree is a row of a shared array, and fewest rows worth one.
TOGETHER, FEW = 126, 24
NONE = (1 << 31) - 1


class Tokenizer:
    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for w, i in self.ranks.items():
            words[i] = w
        #: What each id decodes to, and its decimal form with a comma before it.
        self.decoded = Pieces.of(words)
        self.decimal = Pieces.of([b",%d" % i for i in range(size)])
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        #: No part; it is in no pair.
        self.nil = size
        self._pairs(size + 1)
        self.forget()

    def _pairs(self, base: int) -> None:
        get = self.ranks.get
        keys, ranks = [], []
        for w, rank in self.ranks.items():
            for cut in range(1, len(w)):
                a, b = get(w[:cut]), get(w[cut:])
                if a is not None and b is not None:
                    keys.append(a * base + b)
                    ranks.append(rank)
        keys, ranks = np.array([*keys, -1], np.int64), np.array([*ranks, NONE], np.int64)
        order = np.argsort(keys)
        self.base, self.keys, self.values = base, keys[order], ranks[order]

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.known = Pieces.of([], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the part that two parts make, NONE if they make none."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        tree = [NONE] * (2 * size)
        end = list(range(1, n + 1))  # end of the part that starts at i
        before = list(range(-1, n - 1))  # start of the part to the left
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i : i + 2], NONE)
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        while (least := tree[1]) != NONE:
            i = 1
            while i < size:
                i *= 2
                if tree[i] != least:
                    i += 1
            left = i - size
            right = end[left]
            end[left] = stop = end[right]
            if stop < n:
                before[stop] = left
            changed = [(right, NONE), (left, ranks.get(piece[left : end[stop]], NONE) if stop < n else NONE)]
            if (p := before[left]) >= 0:
                changed.append((p, ranks.get(piece[p:stop], NONE)))
            for at, rank in changed:
                at += size
                tree[at] = rank
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    new = a if a <= b else b
                    if tree[at] == new:
                        break
                    tree[at] = new
                    at >>= 1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_together(self, pieces: list[bytes], size: int) -> Pieces:
        """Ids of pieces of at most size - 2 bytes, one tree a row.

        Byte i of a piece is leaf i + 1; the places before the first and behind the last part hold no part,
        so a merge needs no case for the ends. A node is rank * size + place, or none.
        """
        rows, none = len(pieces), NONE * size
        length = np.fromiter(map(len, pieces), np.int64, rows)
        row = np.repeat(np.arange(rows), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + 1
        ids = np.full((rows, size), self.nil, np.int64)
        ids[row, place] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((rows, 2 * size), none, np.int64)
        first = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, size - 1)
        tree[:, size : 2 * size - 1] = np.where(first == NONE, none, first * size + np.arange(size - 1))
        for lo in (1 << k for k in range(size.bit_length() - 2, -1, -1)):
            np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2], out=tree[:, lo : 2 * lo])
        after = np.tile(np.arange(1, size + 1), (rows, 1))
        before = np.tile(np.arange(-1, size - 1), (rows, 1))
        live = np.arange(rows)
        flat = tree.ravel()
        while True:
            root = tree[live, 1]
            live, root = live[root < none], root[root < none]
            if not len(live):
                break
            rank, at = root // size, root % size
            gone = after[live, at]
            stop = after[live, gone]
            prior = before[live, at]
            ids[live, at] = rank
            ids[live, gone] = self.nil
            after[live, at] = stop
            before[live, stop] = at
            made = self.rank(np.concatenate([ids[live, prior], rank]), np.concatenate([rank, ids[live, stop]]))
            leaf = np.concatenate([prior, at])
            base = np.concatenate([live, live, live]) * (2 * size)
            node = np.concatenate([leaf, gone]) + size
            flat[base + node] = np.concatenate([np.where(made == NONE, none, made * size + leaf), np.full(len(live), none)])
            while (node := node >> 1)[0]:
                under = base + 2 * node
                flat[base + node] = np.minimum(flat[under], flat[under + 1])
        kept = ids != self.nil
        return Pieces(ids[kept].astype(np.int32), np.concatenate([[0], np.cumsum(kept.sum(axis=1))]))

    def learn(self, new: list[str]) -> None:
        """Number ``new`` pieces and keep their ids."""
        raw = [p.encode() for p in new]
        found: list[tuple[np.ndarray, Pieces]] = []
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.ranks.get(p, -1) for p in raw), np.int32, len(raw))
        is_whole = np.flatnonzero(whole >= 0)
        found.append((is_whole, Pieces(whole[is_whole], np.arange(len(is_whole) + 1))))
        rest = np.flatnonzero(whole < 0)
        size = np.left_shift(1, np.maximum(2, np.ceil(np.log2(length[rest] + 2)).astype(np.int64)))
        size[length[rest] > TOGETHER] = 0
        for s in np.unique(size):
            which = rest[size == s]
            if s and len(which) >= FEW:
                found += [(part, self.merge_together([raw[i] for i in part], int(s))) for part in np.array_split(which, -(-len(which) * int(s) // (1 << 20)))]
            else:
                found.append((which, Pieces.of([np.array(self.merge(raw[i]), np.int32) for i in which], np.int32)))
        made = Pieces.joined([p for _, p in found])
        order = np.empty(len(raw), np.int64)
        order[np.concatenate([w for w, _ in found])] = np.arange(len(raw))
        n = len(self.number)
        self.number.update(zip(new, range(n, n + len(new)), strict=True))
        self.known = Pieces.joined([self.known, made.take(order)])

    def encode(self, pieces: list[str]) -> Pieces:
        """Ids of each piece."""
        if len(self.number) > MEMO or len(self.known.data) > MEMO_IDS:
            self.forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.number]
        if new:
            self.learn(new)
        return self.known.take(np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)))

    def portions(self, texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
        """Rows, their pieces one behind the other, and how many each has; long texts in several portions."""
        rows, pieces, counts, size = [], [], [], 0
        for row, text in enumerate(texts):
            if rows and size + len(text) > GROUP:
                yield rows, pieces, counts
                rows, pieces, counts, size = [], [], [], 0
            if len(text) > GROUP:
                found = self.pattern.finditer(text)
                while part := [m.group() for m in islice(found, PORTION)]:
                    yield [row], part, [len(part)]
                continue
            some = self.pattern.findall(text)
            rows.append(row)
            pieces += some
            counts.append(len(some))
            size += len(text)
        if rows:
            yield rows, pieces, counts

    def digests(self, texts: list[str], tokens: bool) -> tuple[list[int], list[str], list[str], list[list[np.ndarray]]]:
        """For each text: number of ids, digest of the ids, digest of the decoded bytes, and the ids if asked for."""
        n = [0] * len(texts)
        said, back = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        every: list[list[np.ndarray]] = [[] for _ in texts]
        for rows, pieces, counts in self.portions(texts):
            made = self.encode(pieces)
            ids = made.data
            cut = made.at[np.concatenate([[0], np.cumsum(counts)])]
            decimal, decoded = self.decimal.take(ids), self.decoded.take(ids)
            for row, lo, hi in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                said[row].update(decimal.data[decimal.at[lo] + (not n[row]) : decimal.at[hi]])
                back[row].update(decoded.data[decoded.at[lo] : decoded.at[hi]])
                n[row] += hi - lo
                if tokens:
                    every[row].append(ids[lo:hi])
        return n, [h.hexdigest() for h in said], [h.hexdigest() for h in back], every


class Pieces:
    """Runs of values, one behind the other: run i is data[at[i]:at[i + 1]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    @staticmethod
    def of(runs: list, kind=np.uint8) -> Pieces:
        if kind is np.uint8:
            data = np.frombuffer(b"".join(runs), np.uint8)
        else:
            data = np.concatenate([np.zeros(0, kind), *runs])
        return Pieces(data, np.concatenate([[0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))]).astype(np.int64))

    @staticmethod
    def joined(parts: list[Pieces]) -> Pieces:
        starts = np.cumsum([0, *(len(p.data) for p in parts)])
        return Pieces(np.concatenate([p.data for p in parts]), np.concatenate([[0], *(p.at[1:] + s for p, s in zip(parts, starts[:-1], strict=True))]).astype(np.int64))

    def take(self, which: np.ndarray) -> Pieces:
        """The runs ``which``, in that order."""
        first = self.at[which]
        length = self.at[which + 1] - first
        at = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=at[1:])
        return Pieces(self.data[np.arange(at[-1]) + np.repeat(first - at[:-1], length)], at)


_made: dict[tuple[bytes, str], Tokenizer] = {}


def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """The tokenizer of a worker process for these ranks; of several the last is kept."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizer(ranks, pattern)
    return _made[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes; with ``tokens`` the ids as well."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(shared.value, pattern)
        for b in slices(batches):
            n, ids, back, every = t.digests(b.column(1).to_pylist(), tokens)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if tokens:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(x for e in every for x in e)]), pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        t.forget()  # workers live on

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if tokens else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
