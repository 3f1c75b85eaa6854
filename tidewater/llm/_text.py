"""Vectorised byte-level text helpers shared by the operators of this subpackage.

Everything here works on a slice of an Arrow string column: a flat ``uint8``
array plus row offsets. Words are maximal runs of bytes outside
``\\x20`` and ``\\x09-\\x0D``; bytes of multi-byte characters are never in that
set, so splitting bytes and splitting code points agree. Slices are bounded in
bytes (a single longer row is a slice of its own), which bounds the memory of
a task whatever the batch size is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 17

_rng = np.random.default_rng(0x7D1E)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(int(_P), -1, 2**64))
_S = U64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_CODE = _BYTE_CODE[LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known public hash (xor-shift-multiply)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if column.type == pa.large_binary() else "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offsets


def tidy(run):
    """A task's function that gives freed memory back to the system at its end, as its worker lives on for other stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of row ranges of at most ``most`` bytes, one row at least."""
    flat, offsets = column_bytes(column)
    for lo, hi in row_ranges(offsets, most):
        yield lo, hi, flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def row_ranges(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, end row) of row ranges of at most ``most`` bytes, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row) of the words; the last has one entry more than rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


_powers: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(P^0 ... P^(n-1), P^0 ... P^-n); those of a slice are kept."""
    up, back = _powers
    if len(back) <= n:
        size = max(n, SLICE_BYTES) + 1
        up, back = (np.full(size, x, U64) for x in (_P, _P_INV))
        up[0] = back[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(back, out=back)
        if size <= 4 * SLICE_BYTES:
            _powers[:] = up, back
    return up[:n], back[: n + 1]


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte range, ASCII lower-cased or not; equal ranges have equal hashes wherever they stand."""
    n = len(data)
    if n == 0 or len(start) == 0:
        return np.zeros(len(start), U64)
    power, back = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum((_LOWER_CODE if lower else _BYTE_CODE)[data] * power, out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(U64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's word shingles; fewer words than ``width`` make one shingle, none make none."""
    start, end, first = word_bounds(data, offsets)
    words = range_hash(data, start, end)
    full = np.zeros(0, U64)
    if len(words) >= width:
        full = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            full = full * _S + words[k : len(words) - width + 1 + k]
        full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            h = U64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _S + w
            yield mix(np.array([h], U64))
        else:
            yield np.zeros(0, U64)
