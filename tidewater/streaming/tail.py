"""A stream of the records of growing logs.

``spark.dataSource.register(LogTail)`` and ``readStream.format("framed_log")``
with the folder as ``path``. The offset holds, for each log, the end of its
last whole frame; it never goes back, and a frame that is not all there yet is
read when it is. To find ends, the driver reads headers only, and checks the
last frame; tasks check all frames. A log that breaks off stays where it is
(``broken`` = stop, the default) or fails the stream (fail).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.journal import RANGE, SIDECAR, Bytes, decode, frame_or_gap, open_store

SCHEMA = "path string, lsn long, next_lsn long, payload binary"
_NOT_YET = ("TruncatedHeader", "TruncatedPayload")


def whole_frames(data: Bytes, at: int, width: int) -> tuple[list[int], str]:
    """Boundaries from ``at`` to the end of the last whole frame, ``width`` bytes apart or one frame, and why no more; headers only, and the last frame in full."""
    ends, last = [at], None
    while True:
        what, n = frame_or_gap(data, at)
        if what == "Gap":
            at = n
        elif what == "Ok":
            last, at = at, at + n
            if at - ends[-1] >= width:
                ends.append(at)
        else:
            return _checked(data, ends, last, what)


def _checked(data: Bytes, ends: list[int], last: int | None, state: str) -> tuple[list[int], str]:
    """The boundaries up to the last frame, or up to its start if its checksum is wrong."""
    if last is None:
        return ends, state
    good = data.frame(last)[0]
    end = last + data.measure(last)[1] if good == "Ok" else last
    ends = [e for e in ends if e < end] or ends[:1]
    return [*ends, end] if end > ends[-1] else ends, state if good == "Ok" else good


class _Part(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, width: int, broken: str):
        self.path, self.width, self.broken, self.known = path, width, broken, {}

    def _logs(self) -> dict[str, int]:
        store, place = open_store(self.path)
        found = store.get_file_info(pafs.FileSelector(place, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.type == pafs.FileType.File and SIDECAR not in f.base_name and not f.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, place = open_store(self.path)
        for name, size in self._logs().items():
            at = self.known.get(name, 0)
            if size > at:
                with store.open_input_file(f"{place}/{name}") as source:
                    ends, state = whole_frames(Bytes(source, size), at, 1 << 62)
                if self.broken == "fail" and state not in ("CleanEnd", *_NOT_YET):
                    raise ValueError(f"{name} breaks off at {ends[-1]}: {state}")
                self.known[name] = max(at, ends[-1])
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out, (store, place) = [], open_store(self.path)
        for name, high in end.items():
            low = start.get(name, 0)
            self.known[name] = max(self.known.get(name, 0), high)  # after a restart
            if high > low:
                with store.open_input_file(f"{place}/{name}") as source:
                    ends, _ = whole_frames(Bytes(source, high), low, self.width)
                out += [_Part(name, a, b) for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def read(self, part: _Part):
        store, place = open_store(self.path)
        with store.open_input_file(f"{place}/{part.path}") as source:
            at = part.low
            for lsn, end, payload in decode(Bytes(source, part.high), part.low, part.high):
                at = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), pa.array([lsn], pa.int64()), pa.array([end], pa.int64()), pa.array([payload], pa.binary())],
                    names=["path", "lsn", "next_lsn", "payload"]
                )
            if at != part.high:
                raise ValueError(f"{part.path} breaks off at {at}, before {part.high}")

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)), self.options.get("broken", "stop"))


def offsets(raw: str) -> dict[str, int]:
    """An offset as a stream's progress reports it."""
    return json.loads(raw)
