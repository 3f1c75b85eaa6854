"""Packing of token sequences by non-negative least squares over a length histogram.

Documents longer than a window give full windows and a remainder. Remainders
are binned by length (rounded up); every combination of at most ``DEPTH`` bins
that fills the window is a strategy, and non-negative least squares against
the histogram gives how often to repeat each. Repeat counts are rounded down,
and what that leaves is solved for again, until nothing whole comes out or only
``SLACK`` times what will fill the gaps is left; these residuals are then poured greedily, cut where needed,
first into the gaps that binning left and then into new windows. So only the
last sequence, or the gaps that no residual is left for, is padded.

The driver sees a histogram of ``BINS`` counts and two thousand strategies, of
which a few dozen are used. Ranks and running sums are two-level (per source partition, then
over partition sums), and the pouring is an interval join on position buckets.

Defined results: null or empty texts are the one token ``end``; a null doc_id
passes through; repeated rows are packed each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import id_text, running_total, written
from ._text import IS_SPACE, LOWER, column_bytes, slices, tidy

WINDOW = 4096
BINS = 64
DEPTH = 4
SLACK = 1.5
CACHED_BYTES = 16 << 20  # of one worker's known chunks and their ids
_BUCKET = 8192
_SLICE = 4 << 20
_LEARNT = 1 << 13  # chunks that are learnt at once, as Python objects
_PLAIN = np.where(IS_SPACE, 32, LOWER).astype(np.uint8)  # white space as spaces, ASCII in lower case
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII symbols but the apostrophe, which can begin a contraction


class WordCache:
    """Ids of white-space-separated chunks by the tokenizers library; chunks repeat, so most are looked up."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        closing = {t.removesuffix("</w>"): i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.closes[list(closing.values())] = True
        self.mark = max((w for w in closing if w.isascii() and w.isalpha() and w.islower()), key=lambda w: (len(w), w))  # a rare word of one id
        self.mark_id = closing[self.mark]
        self.forget()

    def forget(self) -> None:
        self.chunks, self.ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, chunks: list[str], mark: str) -> list[bytes]:
        """Chunks, 500 to a text. Letters end with their one token that closes a word; others are followed by ``mark``, which none of them may hold."""
        out: list[bytes] = []
        for lo in range(0, len(chunks), 500):
            part = chunks[lo : lo + 500]
            text = "".join([f"{c} {mark} " for c in part]) if mark else " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.mark_id if mark else self.closes[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, size, ends = ids.tobytes(), ids.itemsize, ends.tolist()
                out += [raw[x * size : (y - bool(mark)) * size] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._encode(part)
        return out

    def _ids_of(self, new: list[str]) -> list[bytes]:
        """Ids of chunks; ASCII symbols after letters are asked for apart, which doesn't change the ids."""
        split, words, rest = {}, set(), set()
        for c in new:
            head = c.rstrip(_TAIL)
            if head.isalpha() and (head.isascii() or max(head) < "İ"):  # from there on lower case can add characters
                words.add(head)
                if len(head) < len(c):
                    tail = c[len(head) :]
                    rest.add(tail)
                    split[c] = (head, tail)
            else:
                rest.add(c)
        words, rest = list(words), list(rest)
        known = dict(zip(words, self._encode_joined(words, ""), strict=True)) | dict(zip(rest, self._encode_joined(rest, self.mark), strict=True))
        return [known[split[c][0]] + known[split[c][1]] if c in split else known[c] for c in new]

    def _places(self, distinct: pa.Array) -> pa.Array:
        """The place of each chunk among the known ones; unknown ones are learnt. Their store is bounded by CACHED_BYTES and a slice."""
        if self.chunks.nbytes + self.ids.nbytes > CACHED_BYTES:
            self.forget()
        at = pc.index_in(distinct, value_set=self.chunks)
        if at.null_count:
            new = distinct.filter(pc.is_null(at))
            parts = [pa.array(self._ids_of(new.slice(lo, _LEARNT).to_pylist()), pa.large_binary()) for lo in range(0, len(new), _LEARNT)]
            self.ids = pa.concat_arrays([self.ids, *parts])
            self.chunks = pa.concat_arrays([self.chunks, new])
            at = pc.index_in(distinct, value_set=self.chunks)
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the first of each and the end of the last) of the texts' bytes and offsets."""
        low = _PLAIN[data]
        before = data[1:] >= 0x80  # a mark that follows can join the small letter only, so a capital stays
        kept = data[:-1][before]
        kept[IS_SPACE[kept]] = 32
        low[:-1][before] = kept
        del before, kept
        plain = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low)])
        chunks = pc.split_pattern(plain, " ")
        coded = chunks.flatten().dictionary_encode()
        places = self._places(coded.dictionary)
        ids = self.ids.take(places.take(coded.indices))
        flat, bounds = column_bytes(ids)
        size = np.dtype(self.kind).itemsize
        return flat[: bounds[-1]].view(self.kind), bounds[chunks.offsets.to_numpy()] // size


_caches: dict[str, WordCache] = {}


def token_ids(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): the document's ids and ``end``, as little-endian bytes of 2 or 4 each."""

    def run(batches):
        own = _caches.setdefault(path, None) or WordCache(path)
        _caches[path] = own
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), _SLICE):
                flat, first = own.encode(data, offsets)
                ids, first = np.insert(flat, first[1:], end), first + np.arange(hi - lo + 1)
                out = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(first * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), out, pa.array(np.full(hi - lo, ids.itemsize, np.int32))],
                    names=["doc_id", "n", "ids", "width"]
                )

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n long, ids binary, width int")


def strategies(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every non-increasing combination of at most ``depth`` bin numbers with the sum ``bins``."""

    def fill(left: int, most: int, parts: int):
        if left == 0:
            yield ()
        elif parts:
            for first in range(min(left, most), 0, -1):
                for rest in fill(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(fill(bins, bins, depth))


def nnls(a: np.ndarray, b: np.ndarray, most: int = 1000) -> np.ndarray:
    """Non-negative least squares by an active set."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        if gain.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[gain.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                x = s
                break
            low = free & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def repeats(histogram: np.ndarray, slack: float = SLACK) -> list[tuple[tuple[int, ...], int]]:
    """(strategy, repeat count) by rounded-down NNLS; never takes more of a bin than there is.

    What rounding leaves is solved for again, until nothing whole comes out or
    no more is left than ``slack`` times what will fill the gaps (half a bin a
    remainder).
    """
    bins, plans = len(histogram), strategies(len(histogram))
    a = np.zeros((bins, len(plans)))
    for k, plan in enumerate(plans):
        for b in plan:
            a[b - 1, k] += 1
    left, out, parts = histogram.astype(np.int64).copy(), {}, 0
    while left.any():
        x, placed = nnls(a, left.astype(float)), 0
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] <= 0:
                break
            need, own = a[:, k].astype(np.int64), len(plans[k])
            spare = float(left @ np.arange(1, bins + 1)) - slack / 2 * parts
            n = min(int(x[k]), *(left[need > 0] // need[need > 0]).tolist(), int(spare / (bins + slack / 2 * own)))
            if n > 0:
                left -= n * need
                placed, parts = placed + n, parts + n * own
                out[k] = out.get(k, 0) + n
        if not placed:
            break
    return [(plans[k], n) for k, n in out.items()]


def pack(docs: DataFrame, path: str, end: int = 2, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = written(token_ids(docs, path, end).withColumn("row", F.monotonically_increasing_id()))
    step = window // BINS
    rows = tokens.select(
        "row", "n", F.shiftright("row", 33).alias("part"), F.expr(f"n div {window}").alias("full"), (F.col("n") % window).alias("rest")
    ).withColumn("bin", F.ceil(F.col("rest") / step))

    # full windows, a sequence each
    full = running_total(rows.where("full > 0"), "part", "row", "full", "before").select(
        "row", F.posexplode(F.expr("sequence(before, before + full - 1)")).alias("k", "sequence_id")
    )
    full = full.select("row", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "sequence_id")
    n_full = rows.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]

    # remainders, by strategy
    histogram = np.zeros(BINS, np.int64)
    for b, c in rows.where("rest > 0").groupBy("bin").count().collect():  # BINS rows at most
        histogram[b - 1] = c
    slots, taken, base = [], np.zeros(BINS, np.int64), n_full
    for plan, count in repeats(histogram):
        for b in sorted(set(plan)):
            per = plan.count(b)
            slots.append((b, int(taken[b - 1]), int(taken[b - 1] + per * count), per, base))
            taken[b - 1] += per * count
        base += count
    slot = F.broadcast(_table(spark, slots, ["bin", "low", "high", "per", "first"]))  # DEPTH rows a strategy at most
    counts = rows.where("rest > 0").groupBy("part", "bin").count()
    ahead = counts.withColumn("ahead", F.sum("count").over(Window.partitionBy("bin").orderBy("part")) - F.col("count")).drop("count")
    ranked = rows.where("rest > 0").withColumn(
        "own", F.row_number().over(Window.partitionBy("part", "bin").orderBy("row")) - 1
    ).join(ahead, ["part", "bin"]).withColumn("rank", F.col("own") + F.col("ahead"))
    start = F.col("full") * window
    placed = ranked.join(slot, (ranked["bin"] == slot["bin"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").select(
        "row", "part", "rest", start.alias("start"), (F.col("first") + F.expr("(rank - low) div per")).alias("sequence_id")
    )
    placed = written(placed)
    fitted = placed.where("sequence_id is not null").select("row", "start", F.col("rest").alias("length"), "sequence_id")

    # residual remainders are poured into the gaps, and then into new windows
    gaps = fitted.groupBy("sequence_id").agg((F.lit(window) - F.sum("length")).alias("gap")).where("gap > 0").withColumn("block", F.expr("sequence_id div 4096"))
    gaps = running_total(gaps, "block", "sequence_id", "gap", "low").select("sequence_id", "low", (F.col("low") + F.col("gap")).alias("high"))
    poured = running_total(placed.where("sequence_id is null").drop("sequence_id"), "part", "row", "rest", "from").withColumn("to", F.col("from") + F.col("rest"))
    n_gap = gaps.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]
    over = lambda low, high: F.explode(F.expr(f"sequence({low} div {_BUCKET}, ({high} - 1) div {_BUCKET})")).alias("bucket")
    into = (
        poured.where(F.col("from") < n_gap)
        .select("*", over("from", "to"))
        .join(gaps.select("*", over("low", "high")), "bucket")
        .where("from < high and low < to")
        .where(F.col("bucket") == F.expr(f"greatest(from, low) div {_BUCKET}"))
        .select("row", (F.col("start") + F.expr("greatest(from, low) - from")).alias("start"), F.expr("least(to, high) - greatest(from, low)").alias("length"), "sequence_id")
    )
    tail = poured.where(F.col("to") > n_gap).withColumn("at", F.greatest("from", F.lit(n_gap)) - n_gap).withColumn("until", F.col("to") - n_gap)
    tail = tail.select("*", F.explode(F.expr(f"sequence(at div {window}, (until - 1) div {window})")).alias("k")).withColumns({"low": F.greatest("at", F.col("k") * window), "high": F.least("until", (F.col("k") + 1) * window)})
    tail = tail.select(
        "row", (F.col("start") + F.lit(n_gap) + F.col("low") - F.col("from")).alias("start"), (F.col("high") - F.col("low")).alias("length"),
        (F.lit(base) + F.col("k")).alias("sequence_id")
    )

    pieces = full.unionByName(fitted).unionByName(into).unionByName(tail)
    pieces = pieces.withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("row", "start")) - F.col("length"))
    of_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))  # one document's pieces
    return tokens.join(of_row, "row").select("doc_id", "n", "ids", "width", "pieces").mapInArrow(
        tidy(_digest), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """Rows of longs as a DataFrame, from Arrow: createDataFrame of a list starts a second set of Python workers on every executor."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))


def _digest(batches):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = []
            for doc_id, n, ids, width, pieces in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for p in pieces:
                    rows.append((doc_id, p["start"], p["length"], zlib.crc32(wide[p["start"] : p["start"] + p["length"]].tobytes()), n, p["sequence_id"], p["offset"]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
