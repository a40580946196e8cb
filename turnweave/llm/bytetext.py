"""Vectorised tokenising and hashing of UTF-8 text held in Arrow batches.

Every Python operator of this subpackage works on the raw bytes of an Arrow
string column: no per-row Python strings are made. A batch is cut into chunks
of whole documents of about ``CHUNK_BYTES`` so that the 8-byte work arrays stay
small whatever the batch size; one document longer than that is a chunk of its
own.

White space means the bytes 0x20 and 0x09-0x0D; those never occur inside a
multi-byte UTF-8 sequence, so byte-level words equal character-level words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: Base of the polynomial hash modulo 2**64 (odd, so it has an inverse).
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value per byte, as is and with A-Z folded to a-z.
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = BYTE_CODES[LOWER]

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        both = []
        for base in (_BASE, _UNBASE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit integers with avalanche (a fresh array)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, padded bytes, starts) of runs of whole rows.

    In the padded bytes each row is preceded by one space and the last is
    followed by one; starts[i] is where row i begins, starts[-1] is one past
    the space that follows the last row.
    """
    offsets, data = string_parts(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        base = offsets[row]
        starts = (offsets[row : end + 1] - base) + np.arange(1, end - row + 2)
        padded = np.full(int(offsets[end] - base) + (end - row) + 1, 32, np.uint8)
        for i in range(row, end):
            s = starts[i - row]
            padded[s : s + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
        yield row, end, padded, starts
        row = end


def prefix_hash(data: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """H with H[j]-H[i] = the weighted sum of data[i:j]; see span_hash."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end), wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def words(padded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words; first[i]:first[i+1] are row i's."""
    inside = ~IS_SPACE[padded]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    s, e = edge[0::2], edge[1::2]
    return s, e, np.searchsorted(s, starts)


def word_hashes(padded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z folded."""
    return span_hash(prefix_hash(padded, LOWER_CODES), s, e)


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n tokens at each position where one fits."""
    size = max(0, len(tokens) - n + 1)
    h = tokens[:size].copy()
    for j in range(1, n):
        h *= _ODD
        h ^= h >> np.uint64(32)
        h += tokens[j : j + size]
    return mix(h, n)


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item when first[i]:first[i+1] are row i's items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct_per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, value) pairs and how often each occurs."""
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
