"""Options of a tree and its log, with the limits that they are clamped to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import functions as fn

METHODS = ("sync", "data", "direct", "mmap", "auto")
MODES = ("dev", "prod", "auto")


@dataclass(frozen=True)
class Options:
    """``root`` confines paths, ``commit_window_us`` 0 turns group commit off; numbers out of range are clamped, words that are none of the known are refused."""

    root: str | None = None
    mode: str = "auto"
    method: str = "auto"
    commit_window_us: int = 500
    commit_most: int = 8
    shards: int = 1

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method {self.method} can't be selected")
        if self.mode not in MODES:
            raise ValueError(f"no mode {self.mode}")
        clamp = lambda name, low, high: object.__setattr__(self, name, min(max(getattr(self, name), low), high))
        clamp("commit_window_us", 0, 100_000)
        clamp("commit_most", 1, 4096)
        clamp("shards", 1, 64)

    def resolve(self, path: Column) -> Column:
        """A path below the root; null if it leaves it. Without a root, paths are folded only."""
        inside = fn.confine(path)
        return inside if self.root is None else F.when(inside.isNotNull(), F.concat_ws("/", F.lit(self.root.rstrip("/")), F.nullif(inside, F.lit(""))))
