"""Removal of long repeated byte strings by suffix arrays of a linear grouping construction.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(in a document of smaller id, or earlier in the same one). Strings meet by
content: every window of ``LENGTH`` bytes owns the ``ANCHOR``-byte string of
least hash in it, so equal windows own equal anchors at equal places, and an
anchor that occurs once owns no repeated window. The windows that an
occurrence of an anchor owns make its region; regions that are equal byte for
byte are a class. Two kinds of text are suffix-sorted, and windows that are
neighbours in the suffix array with ``LENGTH`` bytes in common are equal, of
which only the earliest is an original:

- The first and the last occurrence of a class, joined with those of the
  classes beside it in the same two documents, up to ``SEGMENT`` windows. What
  lies between the first and the last of a class is repeated as a whole, as
  the last is.
- Where an anchor has several classes, their firsts. The windows of a region
  are parted by how many bytes they hold before the anchor, ``PART`` such
  numbers to a piece; all windows of a piece hold its core of
  ``LENGTH - PART + 1`` bytes, so pieces meet by anchor, part and core, and the
  core counts as one symbol. Cores with more than ``BLOCK`` pieces are sorted
  in blocks, whose distinct windows then meet by a shuffle, so neither an
  anchor nor a core is gathered in one task.

The suffix arrays (_grouping.py) come from grouping suffixes by their Lyndon
prefixes, many texts side by side.

Defined results: null texts are empty; texts shorter than ``LENGTH`` bytes
keep everything; documents of one id are ordered by a hash of their texts;
repeated rows (equal id and text) are one document and get the same result;
null ids come before all others; other columns are ignored by
``removal_report`` and kept by ``drop_repeats``, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._grouping import suffix_arrays
from ._spark import cut, maybe_among, whole_row, written
from ._text import _BYTE_CODE, U64, column_bytes, mix, powers, slices, tidy

LENGTH, ANCHOR, PART, SEGMENT, BLOCK = 100, 24, 26, 512, 32
SORTED, HELD = 1 << 19, 4 << 20  # bytes that are sorted side by side, and that a task holds to sort texts of like sizes together
HOT, MOST_HOT = 4096, 100_000  # occurrences of a class that is broadcast, and classes of this kind at most
TASK = 8 << 20  # bytes that a task sorts in all, about
_SPAN = LENGTH - ANCHOR + 1
_NULL_ID = -(2**63)
_LONG = struct.Struct("<q")
_END, _GAP, _SHIFT = 0, 1, 2  # symbols: the end of a text, the end of a region, and what is added to bytes


def _equal_to_next(flat: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each place equal those at the next one; byte for byte, eight at a time."""
    same = np.ones(max(0, len(at) - 1), bool)
    if not len(same):
        return same
    words = np.lib.stride_tricks.sliding_window_view(flat, 8).view(np.uint64)[:, 0]
    left = np.arange(len(same))
    for k in [*range(0, length - 7, 8), length - 8]:
        own = at[left] + k
        equal = words[own] == words[at[left + 1] + k]
        same[left[~equal]] = False
        left = left[equal]
    return same


def repeated_windows(flat: np.ndarray, offsets: np.ndarray, text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the windows of regions [offsets[r], offsets[r + 1]) of ``flat`` in suffix order, group, is the earliest) of equal windows inside each text.

    Regions of a text (``text``, ascending) stand together; ``order`` is that of each byte in the documents, unique.
    """
    n, size = len(text), np.diff(offsets)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    shift = np.arange(n) + np.searchsorted(ends, np.arange(n))  # gaps and ends ahead of each region
    symbols = np.full(len(flat) + n + len(ends), _GAP, np.uint16)
    place = np.arange(len(flat)) + np.repeat(shift, size)
    symbols[place] = flat.astype(np.uint16) + _SHIFT
    stop = offsets[1:][ends] + shift[ends] + 1
    symbols[stop] = _END
    back = np.full(len(symbols), -1, np.int64)
    back[place] = np.arange(len(flat))
    back[place[np.arange(len(flat)) + length > np.repeat(offsets[1:], size)]] = -1  # no window starts there
    sorted_ = back[suffix_arrays(symbols, np.concatenate([[0], stop + 1]))]
    window = sorted_[sorted_ >= 0]
    of = np.repeat(text, size)[window]
    new = np.ones(len(window), bool)
    new[1:] = ~_equal_to_next(flat, window, length) | (of[1:] != of[:-1])
    group = np.cumsum(new) - 1
    earliest = np.minimum.reduceat(order[window], np.flatnonzero(new)) if len(window) else np.zeros(0, np.int64)
    return window, group, order[window] == earliest[group] if len(window) else new


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(row, anchor hash, region hash, position, windows before, windows) of each owned run of windows of a slice.

    A run of windows [lo, lo + windows) owns the anchor at ``position``; its region is [lo, lo + windows - 1 + LENGTH).
    """
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 6
    power, back = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_CODE[data] * power, out=total[1:])
    gram = mix((total[ANCHOR:] - total[:-ANCHOR]) * back[: n - ANCHOR + 1])
    key = (gram >> U64(32) << U64(32)) | np.arange(len(gram), dtype=U64)  # least hash, then leftmost
    least, width = key, 1
    while width * 2 <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    m = n - LENGTH + 1
    least = np.minimum(least[:m], least[_SPAN - width : _SPAN - width + m])
    own = (least & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.flatnonzero(np.arange(m) + LENGTH <= np.repeat(offsets[1:], np.diff(offsets))[:m])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 6
    q = own[inside]
    first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (np.diff(inside) != 1)))
    lo, hi, q = inside[first], inside[np.append(first[1:], len(inside)) - 1], q[first]
    row = np.searchsorted(offsets, lo, "right") - 1
    region = mix((total[hi + LENGTH] - total[lo]) * back[lo] + mix(((q - lo) * 1024 + (hi - lo)).astype(U64)))
    return row, gram[q].view(np.int64), region.view(np.int64), q - offsets[row], q - lo, hi - lo + 1


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _anchor_batches(batches):
    for batch in batches:
        ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo, _, data, offsets in slices(batch.column(2)):
            row, fp, region, at, before, windows = anchors(data, offsets)
            packed = (at - before) << 16 | before << 8 | windows
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, region, ids[lo + row], marks[lo + row], packed)], names=["fp", "region", "id", "mark", "run"])


def _anchor_hashes(batches):
    """The anchors' hashes alone."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offsets)[1])], names=["fp"])


def pieces(raw: bytes, fp: int, run: int):
    """(key, lowest window's place, windows, symbols) of each piece of an owned run: key stands for anchor, part and core, \xff takes the place of the core."""
    lo, before, windows = run >> 16, run >> 8 & 0xFF, run & 0xFF
    anchor, least = lo + before, before - windows + 1
    for part in range(least // PART, before // PART + 1):
        most_here, least_here = min(before, part * PART + PART - 1), max(least, part * PART)
        core = anchor - part * PART
        end = core + LENGTH - PART + 1
        key = hashlib.blake2b(raw[core:end], digest_size=8, salt=struct.pack("<qB", fp, part)).digest()
        yield *_LONG.unpack(key), anchor - most_here, most_here - least_here + 1, raw[anchor - most_here : core] + b"\xff" + raw[end : anchor - least_here + LENGTH]


def _segments(batches):
    """The runs of adjacent regions that a document (its last) shares with another (their first), cut to SEGMENT windows: a row for each side."""
    for batch in batches:
        out = []
        for doc, mark, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = sorted((x["first"]["id"], x["first"]["mark"], (x["run"] >> 16) - (x["first"]["run"] >> 16), x["run"] >> 16, x["run"] & 0xFF) for x in shared)
            at = 0
            while at < len(rows):
                other, its, shift, low, n = rows[at]
                at += 1
                while at < len(rows) and rows[at][:3] == (other, its, shift) and rows[at][3] == low + n:
                    n += rows[at][4]
                    at += 1
                for lo in range(low, low + n, SEGMENT):
                    windows = min(SEGMENT, low + n - lo)
                    (pair,) = _LONG.unpack(hashlib.blake2b(struct.pack("<6q", other, its, lo - shift, doc, mark, lo), digest_size=8).digest())
                    out += [(other, its, pair, lo - shift, windows), (doc, mark, pair, lo, windows)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["id", "mark", "fp", "low", "windows"])


_CUT = "whole boolean, key long, id long, mark long, low long, windows int, symbols binary"


def _cut_wanted(batches):
    """Wanted segments (whole) and the pieces of wanted regions, with their bytes."""
    names, types = [x.split()[0] for x in _CUT.split(", ")], [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        for at in range(0, len(batch), 64):
            out: list[tuple] = []
            for doc, mark, text, wanted in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                raw = text.encode()
                for w in wanted:
                    if w["windows"] is None:
                        out += [(False, key, doc, mark, low, n, symbols) for key, low, n, symbols in pieces(raw, w["fp"], w["low"])]
                    else:
                        out.append((True, w["fp"], doc, mark, w["low"], w["windows"], raw[w["low"] : w["low"] + w["windows"] - 1 + LENGTH]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)


_JUDGED = "key long, id long, mark long, low long, high long, window binary"


def _judge(rows: pa.Table, length: int):
    """(low, high) of each run of repeated windows of whole texts, and the distinct windows of cores in several blocks."""
    key, block, blocks, ids, marks, low = (rows[c].to_numpy() for c in ("key", "block", "blocks", "id", "mark", "low"))
    flat, offsets = column_bytes(rows["symbols"].combine_chunks().cast(pa.large_binary()))
    flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    text = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
    by = np.lexsort((marks, ids))
    new = np.append(False, (ids[by][1:] != ids[by][:-1]) | (marks[by][1:] != marks[by][:-1]))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    size = np.diff(offsets)
    weight = np.bincount(text, weights=size)
    order = np.argsort(weight[text], kind="stable")  # texts of like sizes together; their rows stay together
    at = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))
    cuts = [0]
    total = np.append(0, np.cumsum(size[order]))
    for k in at[1:].tolist():
        if total[k] - total[cuts[-1]] > SORTED:
            cuts.append(k)
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        mine = order[a:b]
        n = size[mine]
        bounds = np.append(0, np.cumsum(n))
        owner = np.repeat(np.arange(len(mine)), n)
        inside = np.arange(bounds[-1]) - bounds[owner]
        part = flat[offsets[mine][owner] + inside]
        start = low[mine][owner] + inside  # of the window that begins at each symbol
        window, _, earliest = repeated_windows(part, bounds, text[mine], rank[mine][owner] << 40 | start, length)
        again = np.zeros(len(part) + 1, bool)
        again[window[~earliest]] = True
        edge = np.flatnonzero(again[1:] != again[:-1]) + 1
        first, end = (np.append(0, edge) if again[0] else edge).reshape(-1, 2).T  # no run crosses a row: its last symbols begin no window
        own = mine[owner[first]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[own]), pa.array(ids[own]), pa.array(marks[own]), pa.array(start[first]), pa.array(start[end - 1] + LENGTH), pa.nulls(len(own), pa.binary())],
            names=["key", "id", "mark", "low", "high", "window"]
        )
        apart = window[earliest]
        apart = apart[blocks[mine[owner[apart]]] > 1]
        for lo in range(0, len(apart), 10_000):
            k = apart[lo : lo + 10_000]
            own = mine[owner[k]]
            digest = [hashlib.blake2b(part[x : x + length].tobytes(), digest_size=16).digest() for x in k.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[own]), pa.array(ids[own]), pa.array(marks[own]), pa.array(start[k]), pa.array(start[k] + LENGTH), pa.array(digest, pa.binary())],
                names=["key", "id", "mark", "low", "high", "window"]
            )


def _sort_texts(length: int):
    """Rows arrive sorted by (key, block); whole texts are judged, HELD bytes or one text at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            held.append(batch)
            weight += batch.column(batch.schema.get_field_index("symbols")).nbytes
            if weight > HELD:
                rows = pa.Table.from_batches(held)
                key, block = rows["key"].to_numpy(), rows["block"].to_numpy()
                last = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))[-1]  # more of it may come
                if last:
                    yield from _judge(rows.slice(0, last), length)
                held = rows.slice(last).to_batches()
                weight = sum(b.column(b.schema.get_field_index("symbols")).nbytes for b in held)
        if weight:
            yield from _judge(pa.Table.from_batches(held), length)

    return run


def _sorted(rows: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows and distinct windows of rows with key, block, blocks; a fixed number of tasks, which aren't coalesced."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("symbols")), F.lit(0))).first()[0]
    dealt = rows.repartition(max(1, -(-size // TASK)), "key", "block").sortWithinPartitions("key", "block")
    return dealt.select("key", "block", "blocks", "id", "mark", "low", "symbols").mapInArrow(tidy(_sort_texts(length)), _JUDGED)


def repeats(docs: DataFrame) -> DataFrame:
    """(id, mark, spans): the byte ranges to remove from each document that has any, unsorted and overlapping."""
    texts = _keyed(docs)
    place = F.struct("id", "mark", "run")
    found = texts.mapInArrow(tidy(_anchor_batches), "fp long, region long, id long, mark long, run long")
    hashes = texts.select("text").mapInArrow(tidy(_anchor_hashes), "fp long")
    often = written(hashes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))  # written, so that a skewed join with it can be split
    occurs = written(found.join(often, "fp"))
    classes = written(occurs.groupBy("fp", "region").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")))
    several = cut(classes.groupBy("fp").agg(F.count("*").alias("classes")).where("classes > 1").select("fp"))
    firsts = classes.join(several, "fp").select("first.id", "first.mark", "fp", F.col("first.run").alias("low"), F.lit(None).cast("long").alias("windows"))
    twice = classes.where("first <> last")
    shared = twice.groupBy("last.id", "last.mark").agg(F.collect_list(F.struct("first", "last.run")).alias("shared"))  # at most as long as the document
    wanted = firsts.union(shared.mapInArrow(tidy(_segments), "id long, mark long, fp long, low long, windows long"))
    wanted = written(wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("fp", "low", "windows")).alias("want")))  # at most as long as the document, and what copies ask of it
    regions = maybe_among(texts, wanted, ["id", "mark"]).join(wanted, ["id", "mark"]).select("id", "mark", "text", "want")
    regions = written(regions.mapInArrow(tidy(_cut_wanted), _CUT))
    pairs = _sorted(regions.where("whole").select("*", F.lit(0).alias("block"), F.lit(1).alias("blocks")), LENGTH)
    parted = regions.where("not whole")
    cores = cut(parted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    parted = parted.join(cores, "key").withColumn("block", F.pmod(F.xxhash64("id", "mark", "low"), "blocks").cast("int"))
    judged = written(_sorted(parted, PART).union(pairs))
    own = judged.where("window is null").select("id", "mark", "low", "high")
    # windows of cores in several blocks
    apart = judged.where("window is not null").withColumn("place", F.struct("id", "mark", "low"))
    first = apart.groupBy("key", "window").agg(F.min("place").alias("earliest"))
    later = apart.join(first, ["key", "window"]).where("place <> earliest").select("id", "mark", "low", "high")
    # occurrences between the first and the last of a class
    many = classes.where("n > 2 and first <> last").select("fp", "region", "first", "last", "n")
    hot = cut(many.where(F.col("n") > HOT))
    if 0 < hot.count() <= MOST_HOT:  # a class of very many copies is met where its copies are, not in one task
        by_key = occurs.join(F.broadcast(hot.select("fp", "region")), ["fp", "region"], "left_anti").join(many.where(F.col("n") <= HOT), ["fp", "region"])
        between = by_key.union(occurs.join(F.broadcast(hot), ["fp", "region"]))
    else:
        between = occurs.join(many, ["fp", "region"])
    between = between.where((place != F.col("first")) & (place != F.col("last")))
    low = F.shiftright("run", 16)
    between = between.select("id", "mark", low.alias("low"), (low + F.col("run").bitwiseAND(0xFF) - 1 + LENGTH).alias("high"))
    return written(own.union(later).union(between).groupBy("id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("spans")))


def _removed(raw: bytes, spans) -> tuple[list[tuple[int, int]], bytes]:
    merged: list[list[int]] = []
    for lo, hi in sorted((s["low"], s["high"]) for s in spans or ()):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    kept, at = [], 0
    for lo, hi in merged:
        kept.append(raw[at:lo])
        at = hi
    return [(lo, hi) for lo, hi in merged], b"".join([*kept, raw[at:]])


def _digest(batches):
    for batch in batches:
        for at in range(0, len(batch), 128):
            out = []
            for doc, mark, text, spans in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                gone, kept = _removed(text.encode(), spans)
                out.append((doc, mark, sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)],
                names=["id", "mark", "n_removed", "n_spans", "kept"]
            )


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; a row for each row of ``docs``."""
    spans = repeats(docs)
    changed = maybe_among(_keyed(docs), spans, ["id", "mark"]).join(spans, ["id", "mark"]).select("id", "mark", "text", "spans")
    changed = changed.mapInArrow(tidy(_digest), "id long, mark long, n_removed long, n_spans long, kept string").dropDuplicates(["id", "mark"])
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"),
        F.xxhash64(text).alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole")
    )
    out = facts.join(changed, ["id", "mark"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` and ``n_chars`` counted anew, whatever the other columns are called.

    A character of which only some bytes are repeated goes as a whole.
    """
    names, schema = docs.columns, docs.schema
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"),
        whole_row(docs).alias("row")
    )
    joined = keyed.join(repeats(docs), ["id", "mark"], "left").select("row", "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                own = part.column(0).flatten()
                texts = [
                    t if not s or t is None else _removed(t.encode(), s)[1].decode("utf-8", "ignore") for t,
                    s in zip(own[names.index("text")].to_pylist(), part.column(1).to_pylist(), strict=True)
                ]
                own[names.index("text")] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    own[names.index("n_chars")] = pa.array([len(t or "") for t in texts]).cast(own[names.index("n_chars")].type)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(own, names=names)], names=["row"])

    return joined.mapInArrow(tidy(run), StructType([StructField("row", schema)])).select("row.*")
