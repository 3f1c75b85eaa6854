"""Summaries of operation timings: rollups, nearest-rank percentiles, tail verdicts, regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log import frame_len, running_total

TAIL_RATIO = 10.0


def rollup(events: DataFrame, kind: str, size: Column, failed: Column) -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("calls"), F.sum(size).cast("long").alias("bytes"), F.sum(failed.cast("long")).alias("errors"))


def _ranks(events: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, value, c, hi, n): each distinct value, its count, the count up to it and that of its kind.

    Values are dealt by ranges of (kind, value), so neither a kind of many rows
    nor one of many distinct values is sorted in one task.
    """
    counts = events.groupBy(kind, value).agg(F.count("*").alias("c"))
    upto = running_total(counts, [kind, value], "c", "hi")
    kinds = upto.groupBy(kind).agg(F.sum("c").alias("n"), F.min(F.col("hi") - F.col("c")).alias("_base"))
    return upto.join(kinds, kind).withColumn("hi", F.col("hi") - F.col("_base")).drop("_base")


def _at_ranks(upto: DataFrame, kind: str, value: str, at: dict[str, Column]) -> DataFrame:
    inside = lambda k: (k < F.col("hi")) & (k >= F.col("hi") - F.col("c"))
    return upto.groupBy(kind).agg(F.sum("c").alias("n"), *(F.max(F.when(inside(k), F.col(value))).alias(name) for name, k in at.items()))


def nearest_rank(events: DataFrame, kind: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The value at rank round(share * (n - 1)) of each kind."""
    return _at_ranks(_ranks(events, kind, value), kind, value, {name: F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) for name, p in shares.items()})


def tail_verdict(percentiles: DataFrame) -> DataFrame:
    ratio = F.col("p999") / F.greatest("p50", F.lit(0.001))
    return percentiles.withColumn("ratio", ratio).withColumn("status", F.when(F.col("ratio") <= TAIL_RATIO, "OK").otherwise("INVESTIGATE"))


# By how many per cent benchmarks of each class may get worse.
LIMITS = {"critical": 5, "standard": 10, "loose": 25}


def regression(change_pct: Column, strictness: Column) -> Column:
    """pass, fail (critical and standard ones) or warn (loose ones) for a change against a baseline; no baseline is skipped."""
    limit = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))[strictness]
    return F.when(change_pct.isNull(), "skipped").when(change_pct <= limit, "pass").when(strictness == "loose", "warn").otherwise("fail")


def baselines(lines: Column) -> Column:
    """struct(name, value) of a line that gives a number or null for a name; null for other lines."""
    hit = lambda k: F.regexp_extract(lines, r'^\s*"([^"_][^"]*)"\s*:\s*(null|-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*,?\s*$', k)
    return F.when(hit(1) != "", F.struct(hit(1).alias("name"), F.nullif(hit(2), F.lit("null")).cast("double").alias("value")))


def truncated_rank(events: DataFrame, kind: str, value: str) -> DataFrame:
    """Median and p99 at the ranks n div 2 and floor(0.99 n), the other convention of the measurements."""
    return _at_ranks(_ranks(events, kind, value), kind, value, {"p50": F.expr("n div 2"), "p99": F.expr("least(n - 1, n * 99 div 100)")})


def append_events(calls: DataFrame, call: str, payload: str, failed: Column) -> DataFrame:
    """One event a call of append (one record or a batch): records, bytes with their framing (0 where it failed), error."""
    sums = calls.groupBy(call).agg(F.count("*").alias("records"), F.sum(frame_len(F.col(payload))).alias("bytes"), F.bool_or(failed).alias("error"))
    return sums.withColumn("bytes", F.when(F.col("error"), F.lit(0)).otherwise(F.col("bytes")).cast("long"))


def sync_events(commits: DataFrame, lsn: str) -> DataFrame:
    """One event a commit, its leader's: followers and the frontier that it made durable. ``commits`` has leader_id and followers_before."""
    return commits.groupBy("leader_id").agg((F.count("*") - 1).alias("followers"), F.max(lsn).alias("durable_lsn"))


def io_events(calls: DataFrame, op: Column, size: Column, nanos: Column, failed: Column) -> DataFrame:
    """Events of whole-file writes and reads; ranged reads and writes and directory operations give none. A failed one moved 0 bytes."""
    made = calls.select("*", op.alias("kind"), F.when(failed, F.lit(0)).otherwise(size).cast("long").alias("bytes"), nanos.cast("long").alias("duration_ns"), failed.alias("error"))
    return made.where(F.col("kind").isin("write", "read"))


def throughput(events: DataFrame, kind: str, seconds: Column) -> DataFrame:
    """Operations a second of each kind."""
    return events.groupBy(kind).agg(F.count("*").alias("ops"), (F.count("*") / F.sum(seconds)).alias("per_second"))
