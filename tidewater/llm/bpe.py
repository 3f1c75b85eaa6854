"""Byte-level BPE encoding and decoding in padded numpy matrices.

The distinct matches of the split pattern become rows of byte ids, grouped in
buckets of similar length and padded. Each round every row merges its leftmost
pair of minimum rank: ranks of adjacent pairs come from a hashed pair table
and are kept beside the ids, so a round looks up only the two pairs that the
merge made new; rows without a mergeable pair leave the matrix (compaction).
Matches longer than ``LONG`` bytes, for which rounds times width would grow
with the square, take the same merges one by one from a heap.

Defined results: null texts are empty (no ids, hashes of nothing); special
tokens do not exist, their strings are ordinary text; a null doc_id passes
through; extra columns are ignored; each input row gives one row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import id_text

LONG = 256
NONE = np.int32(2**31 - 1)
CACHED_BYTES = 48 << 20  # of the matches that a worker keeps between batches, about; beyond it the cache starts anew
_WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, LONG)


class PairTable:
    """(left id, right id) -> merged id, in an open-addressed hash table of numpy arrays."""

    def __init__(self, tokens: dict[bytes, int]):
        pairs = {(tokens[t[:k]], tokens[t[k:]]): i for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens}
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.key[slot[left]] == -1
            take = left[free]
            _, one = np.unique(slot[take], return_index=True)
            won = take[one]
            self.key[slot[won]], self.value[slot[won]] = key[won], value[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair does not merge or an id is padding (-1)."""
        key = np.ascontiguousarray(left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        key[(left < 0).ravel() | (right < 0).ravel()] = -2
        slot = self._slot(key)
        got = self.key[slot]
        out = np.where(got == key, self.value[slot], NONE)
        open_ = np.flatnonzero((got != key) & (got != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.key[slot[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out.reshape(left.shape)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        space = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(space).findall
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _keep(self, match: str, ids: np.ndarray) -> None:
        k, n = len(self.index), len(ids)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if k == len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.ids[self.used : self.used + n] = ids
        self.start[k], self.count[k], self.index[match] = self.used, n, k
        self.used += n
        self.weight += 160 + 2 * len(match) + 4 * n

    def learn(self, matches: list[str]) -> None:
        """Encodes matches that the cache does not hold yet."""
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for m in matches:
            raw = m.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self._keep(m, np.array([whole], np.int32))
            elif len(raw) > LONG:
                self._keep(m, self.merge_long(raw))
            else:
                rows.setdefault(next(w for w in _WIDTHS if w >= len(raw)), []).append((m, raw))
        for width, own in rows.items():
            for lo in range(0, len(own), 20_000):
                part = own[lo : lo + 20_000]
                for k, ids in self.merge([raw for _, raw in part], width):
                    self._keep(part[k][0], ids)

    def merge(self, raws: list[bytes], width: int):
        """(row, ids) of each row, by rounds over the matrix."""
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(len(raws), width)
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        ids = np.where(np.arange(width) < length[:, None], self.single[flat], np.int32(-1))
        rank = self.pairs.look(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(raws))
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            if (over := best == NONE).any():
                for k, got, n in zip(row[over].tolist(), ids[over], length[over].tolist(), strict=True):
                    yield k, got[:n]
                keep = ~over
                ids, rank, row, length, at, best = ids[keep], rank[keep], row[keep], length[keep], at[keep], best[keep]
                if not len(row):
                    return
            each, at_ = np.arange(len(row)), at[:, None]
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at_), axis=1)
            ids[each, at] = best
            length = length - 1
            if ids.shape[1] == 1:
                rank = np.full((len(row), 1), NONE, np.int32)
                continue
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at_), axis=1)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pairs.look(ids[before, at[before] - 1], best[before])
            after = np.flatnonzero(at < rank.shape[1])
            rank[after, at[after]] = self.pairs.look(best[after], ids[after, at[after] + 1])

    def merge_long(self, raw: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.pairs.look(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(rank.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (t := self.ranks.get(self.bytes_of[ids[x]] + self.bytes_of[ids[y]])) is not None:
                    heapq.heappush(heap, (t, x, ids[x], ids[y]))
        return np.array([i for i, live in zip(ids, alive, strict=True) if live], np.int32)

    def encode(self, texts: list[str]):
        """The ids of each text."""
        found = [self.find(t) for t in texts]
        if self.weight > CACHED_BYTES:
            self._empty()
        if new := {m for f in found for m in f}.difference(self.index):
            self.learn(sorted(new))
        for f in found:
            which = np.fromiter(map(self.index.__getitem__, f), np.int64, len(f))
            count = self.count[which]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(f) else 0
            yield self.ids[np.repeat(self.start[which] - (ends - count), count) + np.arange(total)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary file of "base64 rank" lines."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        _encoders[path, pattern] = Encoder(ranks, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    return _apply(docs, path, pattern, "doc_id long, n_tokens long, ids binary", lambda own, ids: (len(ids), ids.astype("<u4").tobytes()), [pa.int64(), pa.binary()])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def digest(own: Encoder, ids: np.ndarray):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _apply(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()])


def _apply(docs: DataFrame, path: str, pattern: str, schema: str, digest, types) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            texts, lo = batch.column(1), 0
            while lo < len(batch):
                hi, size = lo, 0
                while hi < len(batch) and (hi == lo or size < 1 << 20):
                    size += len(texts[hi].as_py())
                    hi += 1
                rows = list(zip(*(digest(own, ids) for ids in own.encode(texts.slice(lo, hi - lo).to_pylist())), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], names=names)
                lo = hi

    return id_text(docs).mapInArrow(run, schema)
