"""CRC-32C of many byte strings at once, in numpy.

A checksum register that starts at zero ignores leading zeros and is linear:
that of a concatenation is the first one's, moved on by the second's length,
xor the second's. So strings are cut into blocks of ``BLOCK`` bytes (the first
padded in front), all blocks run side by side, and neighbours are merged in
rounds, with a table for each power of two that a register is moved on by.
"""

from __future__ import annotations

import functools

import numpy as np

_POLY = np.uint32(0x82F63B78)
BLOCK = 64
_U32 = np.uint32


def _byte_table() -> np.ndarray:
    r = np.arange(256, dtype=_U32)
    for _ in range(8):
        r = np.where(r & _U32(1), r >> _U32(1) ^ _POLY, r >> _U32(1))
    return r


_BYTE = _byte_table()


def _moved(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Registers moved on over zeros; tables: (4, 256), one row a byte of the register."""
    return tables[0][r & _U32(255)] ^ tables[1][r >> _U32(8) & _U32(255)] ^ tables[2][r >> _U32(16) & _U32(255)] ^ tables[3][r >> _U32(24)]


@functools.cache
def _zeros(k: int) -> np.ndarray:
    """The tables of 2^k zero bytes."""
    if k == 0:
        r = np.arange(256, dtype=_U32)[None, :] << (_U32(8) * np.arange(4, dtype=_U32)[:, None])
        return _BYTE[r & _U32(255)] ^ r >> _U32(8)
    half = _zeros(k - 1)
    return np.stack([_moved(half, half[j]) for j in range(4)])


def crc32c_many(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The checksum of each [offsets[i], offsets[i + 1]) of ``flat``."""
    n = np.diff(offsets)
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    start = first[:-1] * BLOCK + blocks * BLOCK - n  # pads stand in front
    shift = np.repeat(start - offsets[:-1], n)
    at = np.arange(int(offsets[0]), int(offsets[-1]))
    padded[at + shift] = flat[int(offsets[0]) : int(offsets[-1])]
    r = np.zeros(int(first[-1]), _U32)
    for column in padded.reshape(-1, BLOCK).T:
        r = _BYTE[(r ^ column) & _U32(255)] ^ r >> _U32(8)
    level = BLOCK.bit_length() - 1
    while (blocks > 1).any():
        merged = -(-blocks // 2)
        ahead = np.concatenate([[0], np.cumsum(merged)])
        row = np.repeat(np.arange(len(n)), merged)
        pair = np.arange(int(ahead[-1])) - ahead[row]
        right = first[row + 1] - 1 - 2 * (merged[row] - 1 - pair)  # pairs are counted from the end, so that an odd block is the first
        left = right - 1
        alone = left < first[row]
        r = r[right] ^ np.where(alone, _U32(0), _moved(_zeros(level), r[np.where(alone, 0, left)]))
        first, blocks, level = ahead, merged, level + 1
    out = np.zeros(len(n), _U32)
    out[blocks > 0] = r
    head = np.full(len(n), 0xFFFFFFFF, _U32)  # what the register starts with, moved on by each length
    for k in range(int(n.max(initial=0)).bit_length()):
        head = np.where(n >> k & 1, _moved(_zeros(k), head), head)
    return out ^ head ^ _U32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_many(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])
