"""Vectorised hashing of words, shingles and byte windows over Arrow batches of texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = _PI if inverse else _P
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P^0 .. at least P^n modulo 2^64 (of the inverse of P if ``inverse``)."""
    return _powers(max(BLOCK, 1 << int(n).bit_length()), inverse)


def prefix(codes: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """S with S[e] - S[s] = sum of table[codes[j]] * P^j over s <= j < e, modulo 2^64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(table[codes] * powers(len(codes))[: len(codes)], out=out[1:])
    return out


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): depends on its content and length only."""
    raw = (s[end] - s[start]) * powers(len(s), True)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts (first row, end row, bytes, offsets) of a batch, each of about ``limit`` bytes but of one whole text at
    least. Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, len(col))
        yield i, j, data[off[i] : off[j]], (off[i : j + 1] - off[i])
        i = j


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of binaries, and their offsets (rows + 1 entries), without a copy. Nulls are empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each row's first word (rows + 1 entries)."""
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = off[:-1][off[:-1] < len(data)]
    start[firsts] = solid[firsts]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = solid
    end[:-1] &= ~solid
    cut = off[1:]
    cut = cut[cut > 0]
    end[cut] = solid[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s, e, np.searchsorted(s, off)


def word_shingles(data: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text, its sorted distinct hashes of k-word runs; of the whole text if it has fewer words."""
    s, e, row = words(data, off)
    if not len(s):
        return [np.zeros(0, np.uint64)] * (len(off) - 1)
    h = span_hash(prefix(data), s, e)
    run = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        n = len(h) - j
        run[:n] = mix(run[:n] + h[j:] * np.uint64(2 * j + 0x9E3779B97F4A7C15))
    out = []
    for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            v = np.asarray([b - a], np.uint64)
            for x in h[a:b]:
                v = mix(v * np.uint64(31) + x)
            out.append(v)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])
