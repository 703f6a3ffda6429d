"""Vectorised word and shingle hashing over Arrow string arrays.

A word is a maximal run of bytes that are not ASCII white space. A shingle is five consecutive words;
a text of one to four words has one shingle, an empty text has none. Hashes are 64-bit and depend on
the bytes alone, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
# Folded words: ASCII letters, digits and non-ASCII bytes; ASCII case does not count.
_BREAK = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def strings(column) -> pa.Array:
    """An Arrow column as one plain string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes (one long text may exceed it): first row, bytes, offsets."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, folded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and for each row the place of its first word."""
    n = len(data)
    solid = ~(_BREAK if folded else _SPACE)[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((_FOLDED if folded else _BYTE)[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, and for each row the place of its first shingle."""
    count = np.diff(at)
    per = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(count.dtype))
    place = np.zeros(len(at), np.int64)
    np.cumsum(per, out=place[1:])
    row = np.repeat(np.arange(len(per)), per)
    start = np.arange(place[-1]) - place[row] + at[row]
    padded = np.concatenate([hashes, np.zeros(WIDTH, _U)])
    out = padded[start] * _PLACE[0]
    short = (count < WIDTH)[row]
    last = at[1:][row]
    for k in range(1, WIDTH):
        part = padded[start + k] * _PLACE[k]
        if short.any():
            part[short & (start + k >= last)] = 0
        out += part
    return mix(out), place


def shingle_rows(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of a string column: first row, shingle hashes, places."""
    for row, data, offsets in chunks(strings(column)):
        hashes, _, _, at = words(data, offsets)
        yield row, *shingles(hashes, at)
