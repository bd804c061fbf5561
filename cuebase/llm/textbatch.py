"""Vectorised byte and word handling for Arrow batches of texts.

A batch of texts is laid end to end in one byte buffer, so that hashing costs a
few NumPy passes over the buffer instead of a Python call for each word.  All
hashes are 64-bit and depend on content only: every task names the same string
alike.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _splitmix_table(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place where it can be."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


BYTE_CODES = _splitmix_table(7, 256)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_CODES = BYTE_CODES[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)


_POWERS = [np.empty(0, dtype=U64), np.empty(0, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse mod 2**64."""
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 20)
        _POWERS[:] = [_powers(_BASE, m), _powers(_BASE_INV, m)]
    return _POWERS[0][:n], _POWERS[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds most_bytes of text at most, or one row."""
    lengths = np.diff(text_buffer(batch.column(batch.schema.get_field_index(column)))[1])
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each maximal run of non-space bytes; a word never crosses texts."""
    if len(data) == 0:
        e = np.empty(0, dtype=np.int64)
        return e, e, e
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] = solid[inner]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span, of its A-Z lower-cased form by default."""
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        sums = np.empty(len(data) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum((_LOWER_CODES if lower else BYTE_CODES)[data] * up[:-1], dtype=U64, out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]
        h += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix64(h)


def sequence_hashes(codes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of `width` consecutive codes; the caller drops runs that cross texts."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        h = np.full(n, U64(width * 1000003 + salt), dtype=U64)
        for k in range(width):
            h = (h ^ codes[k : k + n]) * U64(0xFF51AFD7ED558CCD)
            h ^= h >> U64(32)
    return mix64(h)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
