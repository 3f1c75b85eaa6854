"""Framed record logs as DataFrames: reading by ranges, tails, repair, writing.

A frame is the magic (big-endian), the payload's length and, after the
payload, the CRC-32C of all before it (both little-endian). Zeros between
frames are skipped up to the next 512-byte boundary, zeros up to the end are a
clean end; a log ends at the first thing that is neither.

A log is read in ranges of ``RANGE`` bytes, each by a task of its own, in
chunks; a task holds one frame and one chunk. Where a range's first frame
starts is guessed from the magic and the checksum, and the ends that ranges
report, one row each, correct the guesses until they agree. Files are opened
by pyarrow's file systems, so a path may name a store that executors reach.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..operators.lineage import cut
from ..operators.log import assign_lsn
from .crc import crc32c, crc32c_many

# Fixed values of the frame format.
MAGIC = 0x46535901
OVERHEAD = 12
MOST_PAYLOAD = 2**28 - 1
SECTOR = 512
MOST_GAP = 64 << 20

RANGE, CHUNK, ROWS = 64 << 20, 1 << 20, 1024
SIDECAR = ".corrupt-"
_HEAD = struct.pack(">I", MAGIC)
_NOT_ZERO = re.compile(rb"[^\0]")


def encode_frame(payload: bytes) -> bytes:
    if len(payload) > MOST_PAYLOAD:
        raise ValueError("payload over the cap")
    head = _HEAD + struct.pack("<I", len(payload)) + payload
    return head + struct.pack("<I", crc32c(head))


def _framed(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Frames without their checksums, and these."""
    heads = [_HEAD + struct.pack("<I", len(p)) + p for p in payloads]
    flat = np.frombuffer(b"".join(heads), np.uint8)
    return heads, crc32c_many(flat, np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int64))


@F.pandas_udf(LongType())
def frame_crc(payload: pd.Series) -> pd.Series:
    known = payload.dropna()
    out = pd.Series([None] * len(payload), index=payload.index, dtype="Int64")
    for lo in range(0, len(known), ROWS):
        part = known.iloc[lo : lo + ROWS]
        out[part.index] = _framed([bytes(p) for p in part])[1].astype(np.int64)
    return out


def frames(payload: Column) -> Column:
    """Payloads as frames, ready to be written in order."""

    def run(s: pd.Series) -> pd.Series:
        heads, sums = _framed([bytes(p) for p in s])
        return pd.Series([h + struct.pack("<I", c) for h, c in zip(heads, sums.tolist(), strict=True)])

    return F.pandas_udf(run, "binary")(payload)


class Bytes:
    """A file read by position, a chunk at a time, up to a size taken when it was opened."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """[at, at + n), less at the end."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.source.read_at(min(max(n, CHUNK), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]

    def after_zeros(self, at: int, most: int) -> int:
        """The first byte from ``at`` on that isn't zero; ``size`` if there is none, and no further than ``most`` bytes."""
        end = min(self.size, at + most)
        while at < end:
            part = self.get(at, min(CHUNK, end - at))
            if m := _NOT_ZERO.search(part):
                return at + m.start()
            at += len(part)
        return at

    def measure(self, at: int) -> tuple[str, int]:
        """("Ok", length) of the frame at ``at`` by its header, which is looked at before anything of that size is read; else (state, 0)."""
        head = self.get(at, 8)
        if len(head) < 8:
            return "TruncatedHeader", 0
        if head[:4] != _HEAD:
            return "BadMagic", 0
        size = struct.unpack_from("<I", head, 4)[0]
        if size > MOST_PAYLOAD:
            return "LengthOverflow", 0
        return ("TruncatedPayload", 0) if at + OVERHEAD + size > self.size else ("Ok", OVERHEAD + size)

    def frame(self, at: int) -> tuple[str, bytes]:
        """(state, payload) of the frame at ``at``."""
        state, n = self.measure(at)
        if state != "Ok":
            return state, b""
        whole = self.get(at, n)
        return ("Ok", whole[8:-4]) if crc32c(whole[:-4]) == struct.unpack("<I", whole[-4:])[0] else ("ChecksumMismatch", b"")

    def sync(self, at: int, end: int) -> int | None:
        """The first whole frame that starts in [at, end)."""
        while at < end:
            part = self.get(at, min(CHUNK, end - at) + 3)
            k = part.find(_HEAD)
            if k < 0:
                at += max(1, len(part) - 3)
            elif at + k < end and self.frame(at + k)[0] == "Ok":
                return at + k
            else:
                at += k + 1
        return None


def frame_or_gap(data: Bytes, at: int) -> tuple[str, int]:
    """What stands at ``at``, by its header: ("Ok", its frame's length), ("Gap", where it ends), or the state that ends the log."""
    if at >= data.size:
        return "CleanEnd", at
    if data.get(at, 1) == b"\0":
        run = data.after_zeros(at, MOST_GAP + 1)
        if run == data.size or run - at > MOST_GAP and data.after_zeros(run, data.size) == data.size:
            return "CleanEnd", at
        return ("TruncatedHeader", at) if run - at > MOST_GAP or run % SECTOR else ("Gap", run)
    return data.measure(at)


def decode(data: Bytes, at: int, end: int):
    """Yields (lsn, next_lsn, payload) of frames that start in [at, end); returns (clean end or None, where it stopped, state: Running at a stop past ``end``).

    Checksums are taken of as many frames at once as ROWS or CHUNK allows.
    """
    clean, state = None, "Running"
    while at < end and state == "Running":
        held, weight = [], 0
        while at < end and len(held) < ROWS and weight < CHUNK:
            what, n = frame_or_gap(data, at)
            if what == "Ok":
                held.append((at, data.get(at, n)))
                at, weight = at + n, weight + n
            elif what == "Gap":
                at = n
            else:
                state = what
                break
        if held:
            sums = crc32c_many(np.frombuffer(b"".join(f[:-4] for _, f in held), np.uint8), np.cumsum([0, *(len(f) - 4 for _, f in held)]))
            for (lsn, frame), c in zip(held, sums.tolist(), strict=True):
                if struct.unpack("<I", frame[-4:])[0] != c:
                    return clean, lsn, "ChecksumMismatch"
                clean = lsn + len(frame)
                yield lsn, clean, frame[8:-4]
    return clean, at, "CleanEnd" if state == "Running" and at >= data.size else state


def decode_all(data: bytes, start: int = 0):
    """Yields the records of a log in memory; returns (clean end, state)."""
    source = Bytes(pa.BufferReader(data), len(data))
    clean, _, state = yield from decode(source, start, max(len(data), start + 1))
    return start if clean is None else clean, state


def open_store(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_len) of the logs at a path, empty ones too; saved tails and hidden files are none."""
    store, place = open_store(path)
    info = store.get_file_info(place)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(place, allow_not_found=True))
    lead = path.rstrip("/") if info.type != pafs.FileType.File else path.rstrip("/").rpartition("/")[0]
    rows = [(f"{lead}/{f.base_name}", f.size) for f in found if f.type == pafs.FileType.File and SIDECAR not in f.base_name and not f.base_name.startswith((".", "_"))]
    return spark.createDataFrame(rows, "path string, file_len long")


def _source(path: str, size: int) -> Bytes:
    store, place = open_store(path)
    return Bytes(store.open_input_file(place), size)


_ENDS = "path string, k long, low long, high long, file_len long, start long, clean long, stop long, state string, records long"


def _ends(batches):
    names = [x.split()[0] for x in _ENDS.split(", ")]
    for batch in batches:
        rows = []
        for path, k, low, high, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "k", "low", "high", "file_len", "start")), strict=True):
            data = _source(path, size)
            if start is None:
                start = data.sync(low, high)
            if start is None:
                rows.append((path, k, low, high, size, None, None, None, "Unknown", 0))
                continue
            found, n = decode(data, start, high), 0
            while True:
                try:
                    next(found)
                    n += 1
                except StopIteration as end:
                    rows.append((path, k, low, high, size, start, *end.value, n))
                    break
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if x in ("path", "state") else pa.int64()) for x, c in zip(names, columns, strict=True)], names=names)


def log_ranges(files: DataFrame, start: int = 0, width: int | None = None) -> DataFrame:
    """Ranges of logs (path, file_len) from ``start``, a frame boundary, on: where each one's first frame starts, where it stops, and in what state.

    A range that is wrong about its start is read again from where the one
    before it stopped; each round settles all ranges up to the next wrong one.
    """
    width = width or RANGE
    spark = files.sparkSession
    per = F.greatest(F.lit(1), F.ceil((F.col("file_len") - start) / width))
    ranges = files.select("path", "file_len", F.explode(F.sequence(F.lit(0).cast("long"), per.cast("long") - 1)).alias("k"))
    low = F.col("k") * width + start
    ranges = ranges.select("path", "k", low.alias("low"), (low + width).alias("high"), "file_len", F.when(F.col("k") == 0, F.lit(start)).cast("long").alias("start"))
    todo, done = cut(ranges), None
    tasks = max(1, spark.sparkContext.defaultParallelism)
    while True:
        read = todo.repartition(tasks * 4, "path", "k").mapInArrow(_ends, _ENDS)
        done = cut(read if done is None else done.join(todo.select("path", "k"), ["path", "k"], "left_anti").unionByName(read))
        before = Window.partitionBy("path").orderBy("k")
        expected = F.lag(F.when(F.col("state") == "Running", F.col("stop"))).over(before)  # one row a range
        wrong = done.withColumn("expected", expected).where("expected is not null and not (start <=> expected)")
        todo = cut(wrong.select("path", "k", "low", "high", "file_len", F.col("expected").alias("start")))
        if todo.isEmpty():
            return done


def _live(ranges: DataFrame) -> DataFrame:
    """The ranges up to the first that ends its log."""
    ended = F.max((F.col("state") != "Running").cast("int")).over(Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0").drop("_ended")


def read_log(spark: SparkSession, path: str, start: int = 0, width: int | None = None) -> DataFrame:
    """(path, lsn, next_lsn, payload_len, payload) of every whole record from ``start``, a frame boundary, on."""
    live = _live(log_ranges(log_files(spark, path), start, width)).where("records > 0").select("path", "file_len", "start", "high")
    names = ["path", "lsn", "next_lsn", "payload_len", "payload"]

    def packed(path, rows):
        lsn, end, payload = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path] * len(rows), pa.string()), pa.array(lsn, pa.int64()), pa.array(end, pa.int64()),
                pa.array(map(len, payload), pa.int64()), pa.array(payload, pa.binary())
            ],
            names=names
        )

    def run(batches):
        for batch in batches:
            for p, size, at, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, weight = [], 0
                for row in decode(_source(p, size), at, high):
                    held.append(row)
                    weight += len(row[2])
                    if weight > CHUNK or len(held) >= ROWS:
                        yield packed(p, held)
                        held, weight = [], 0
                if held:
                    yield packed(p, held)

    tasks = 4 * max(1, spark.sparkContext.defaultParallelism)
    return live.repartition(tasks, "path", "start").mapInArrow(run, "path string, lsn long, next_lsn long, payload_len long, payload binary")


def read_at(spark: SparkSession, path: str, lsn: int) -> DataFrame:
    """(path, lsn, state, payload) of one position of each log: Ok, InvalidData or UnexpectedEof. Reads that frame only."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, payload = _source(p, size).frame(lsn)
                rows.append((p, lsn, {"Ok": "Ok", "TruncatedHeader": "UnexpectedEof", "TruncatedPayload": "UnexpectedEof"}.get(state, "InvalidData"), payload if state == "Ok" else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.string(), pa.int64(), pa.string(), pa.binary()], strict=True)],
                names=["path", "lsn", "state", "payload"]
            )

    return log_files(spark, path).mapInArrow(run, "path string, lsn long, state string, payload binary")


def log_tails(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(path, file_len, clean_end, records, state) of every log."""
    live = _live(log_ranges(log_files(spark, path), 0, width))
    out = live.groupBy("path").agg(
        F.max("file_len").alias("file_len"), F.coalesce(F.max("clean"), F.lit(0)).alias("clean_end"), F.sum("records").alias("records"),
        F.max_by("state", "k").alias("state")
    )
    return out.withColumn("state", F.when(F.col("state") == "Running", "CleanEnd").otherwise(F.col("state")))


def sidecar_name(name: Column, clean_end: Column, attempt: Column) -> Column:
    return F.concat(name, F.lit(SIDECAR), clean_end, F.when(attempt > 0, F.concat(F.lit("."), attempt)).otherwise(""))


def _copied(store, place: str, low: int, high: int, to: str) -> None:
    with store.open_input_file(place) as source, store.open_output_stream(to) as out:
        while low < high:
            part = source.read_at(min(CHUNK, high - low), low)
            if not part:
                raise OSError("the log shrank while its tail was copied")
            out.write(part)
            low += len(part)


def _digest(store, place: str, low: int, high: int) -> bytes:
    h = hashlib.sha256()
    with store.open_input_file(place) as source:
        while low < high:
            part = source.read_at(min(CHUNK, high - low), low)
            h.update(part)
            low += len(part) or high
    return h.digest()


def _saved(store, place: str, low: int, high: int) -> str:
    """Saves a tail beside its log and returns the file's name; one that holds these bytes already is used again."""
    attempt, own = 0, None
    while True:
        to = f"{place}{SIDECAR}{low}" + (f".{attempt}" if attempt else "")
        info = store.get_file_info(to)
        if info.type == pafs.FileType.NotFound:
            temp = f"{to.rpartition('/')[0]}/.{uuid.uuid4().hex}"
            _copied(store, place, low, high, temp)
            store.move(temp, to)
            return to.rpartition("/")[2]
        own = own or _digest(store, place, low, high)
        if info.size == high - low and _digest(store, to, 0, info.size) == own:
            return to.rpartition("/")[2]
        attempt += 1


def repair(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Cuts every log back to its clean end: (path, file_len, clean_end, state, tail, sidecar).

    A tail that holds more than zeros is saved beside the log first
    (``Preserved``); one of zeros, or none, is not. Logs are repaired by tasks,
    a log each; a task that is run again finds what the first one saved, or the
    log in order, so nothing is lost or saved twice.
    """
    names = ["path", "file_len", "clean_end", "state", "tail", "sidecar"]

    def run(batches):
        for batch in batches:
            rows = []
            for p, size, clean, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = open_store(p)
                now, tail, saved = store.get_file_info(place).size, "Empty", None
                if now > clean:
                    with store.open_input_file(place) as source:
                        tail = "Zeros" if Bytes(source, now).after_zeros(clean, now) >= now else "Preserved"
                    saved = _saved(store, place, clean, now) if tail == "Preserved" else None
                    temp = f"{place.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                    _copied(store, place, 0, clean, temp)
                    store.move(temp, place)
                rows.append((p, size, clean, state, tail, saved))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    tails = cut(log_tails(spark, path, width).select("path", "file_len", "clean_end", "state"))
    n = max(1, min(tails.count(), 4 * spark.sparkContext.defaultParallelism))
    return cut(tails.repartition(n, "path").mapInArrow(run, "path string, file_len long, clean_end long, state string, tail string, sidecar string"))


def put(path: str, data: bytes) -> None:
    """A whole small file, replaced at once: written under a hidden name, then renamed."""
    store, place = open_store(path)
    folder = place.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    temp = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, place)


def frontier(path: str) -> int:
    """Where the next record of a segmented log goes: what its last commit published, 0 before the first."""
    store, place = open_store(path)
    found = store.get_file_info(f"{place}/_frontier")
    if found.type == pafs.FileType.NotFound:
        return 0
    with store.open_input_stream(f"{place}/_frontier") as source:
        return int(source.read())


def append(records: DataFrame, order: list[str], payload: str, path: str, most: int = MOST_PAYLOAD) -> int:
    """Appends records in ``order`` to a segmented log, all or none, and returns its new frontier.

    Records get their places by assign_lsn; each task writes the frames of one
    range of places to a hidden file. Only when all tasks are done are the
    files of those that won named by their first place, and the frontier, which
    readers go by, is published last. A record over the cap fails the append;
    files of tasks that were run again or of an append that failed are never named.
    """
    spark, base = records.sparkSession, frontier(path)
    placed = cut(assign_lsn(records, order, payload, most))
    if not placed.where("rejected").isEmpty():
        raise ValueError("a payload is over the cap; nothing is appended")
    store, place = open_store(path)
    store.create_dir(place, recursive=True)
    rows = placed.select((F.col("lsn") + base).alias("lsn"), F.col(payload).cast("binary").alias("payload"))

    def run(batches):
        store, place = open_store(path)
        name, out, first, end = f".{uuid.uuid4().hex}", None, None, None
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                payloads = part.column(1).to_pylist()
                if out is None and payloads:
                    out, first = store.open_output_stream(f"{place}/{name}"), part.column(0)[0].as_py()
                    end = first
                heads, sums = _framed(payloads)
                for lsn, h, c in zip(part.column(0).to_pylist(), heads, sums.tolist(), strict=True):
                    if lsn != end:
                        raise RuntimeError("places are not contiguous")
                    out.write(h + struct.pack("<I", c))
                    end += len(h) + 4
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([end], pa.int64())], names=["name", "low", "high"])

    wrote = rows.repartitionByRange("lsn").sortWithinPartitions("lsn").mapInArrow(run, "name string, low long, high long")
    segments = sorted(wrote.collect(), key=lambda r: r["low"])  # one row a task
    at = base
    for s in segments:
        if s["low"] != at:
            raise RuntimeError("segments are not contiguous")
        at = s["high"]
    for s in segments:
        store.move(f"{place}/{s['name']}", f"{place}/{s['low']:020d}.log")
    put(f"{path}/_frontier", str(at).encode())
    return at


def read_segments(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(lsn, next_lsn, payload) of a segmented log up to its frontier; what lies past it was never committed."""
    base = F.regexp_extract("path", r"(\d{20})\.log$", 1).cast("long")
    rows = read_log(spark, path, 0, width).select((F.col("lsn") + base).alias("lsn"), (F.col("next_lsn") + base).alias("next_lsn"), "payload")
    return rows.where(F.col("next_lsn") <= frontier(path))
