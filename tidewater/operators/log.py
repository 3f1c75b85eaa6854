"""Arithmetic of append-only logs of framed records.

A frame is a 4-byte magic, a 4-byte length, the payload and a 4-byte checksum.
A record's ``lsn`` is the offset at which its frame starts, ``next_lsn`` the one
at which it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

OVERHEAD = 12
MOST_PAYLOAD = 2**28 - 1


def frame_len(payload: Column, most: int = MOST_PAYLOAD) -> Column:
    """Bytes of a record's frame; null where the payload is over the cap."""
    n = F.octet_length(payload)
    return F.when(n <= most, n + OVERHEAD).cast("long")


def running(df: DataFrame, order: list[str], value: str, out: str, how=F.sum, join=lambda a, b: a + b) -> DataFrame:
    """Adds ``out``, the sum (or what ``how`` and ``join`` make) of ``value`` up to and with each row in a global order, without one task that sees all rows.

    Rows are dealt by ranges of the order; each range is summed by itself, and
    only one sum per range goes through a single task. The ranges come from a
    sample, so they are kept: a second sample could draw other ones.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(how(value).alias("_all"))
    before = sums.select("_part", how("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = how(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.coalesce(join(F.col("_in"), F.col("_before")), "_in", "_before")
    return dealt.withColumn("_in", inside).join(before, "_part").withColumn(out, whole).drop("_part", "_in", "_before")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    return running(df, order, value, out)


def assign_lsn(records: DataFrame, order: list[str], payload: str, most: int = MOST_PAYLOAD) -> DataFrame:
    """``lsn`` and ``next_lsn`` of records appended in ``order``; one over the cap is ``rejected`` and takes no place."""
    framed = records.withColumn("frame_len", frame_len(F.col(payload), most)).withColumn("rejected", F.col("frame_len").isNull())
    placed = running_total(framed, order, "frame_len", "_end")
    return placed.withColumns({"next_lsn": F.when(~F.col("rejected"), F.col("_end")), "lsn": F.col("_end") - F.col("frame_len")}).drop("_end")


def append_batches(records: DataFrame, batch: str, payload: str, most: int = MOST_PAYLOAD) -> DataFrame:
    """Per batch (in order of ``batch``): records, bytes, start and end; a batch with a record over the cap is ``rejected`` whole, writes nothing and has no place."""
    framed = records.select(batch, frame_len(F.col(payload), most).alias("_len"))
    sums = framed.groupBy(batch).agg(F.count("*").alias("records"), F.sum("_len").alias("_bytes"), F.bool_or(F.col("_len").isNull()).alias("rejected"))
    sums = sums.withColumn("bytes", F.when(F.col("rejected"), F.lit(0)).otherwise(F.col("_bytes")).cast("long")).drop("_bytes")
    placed = running_total(sums, [batch], "bytes", "_end")
    return placed.withColumns({"end_lsn": F.when(~F.col("rejected"), F.col("_end")), "start_lsn": F.when(~F.col("rejected"), F.col("_end") - F.col("bytes"))}).drop("_end")


def frontier(records: DataFrame, end: str = "next_lsn") -> DataFrame:
    """The next free position, or the highest durable one: the greatest end, 0 for an empty log. One row."""
    return records.agg(F.coalesce(F.max(end), F.lit(0)).cast("long").alias("lsn"))


def _parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by ranges of ``order`` and kept so; ``_part`` rises with the order."""
    return cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def gaps(records: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """Records whose predecessor (of the same ``group``, if given) does not end where they start.

    Ranges of the order are looked at each by itself, with the last record of
    the range before; a group of any size spreads over many ranges.
    """
    keys = [*([group] if group else []), order]
    dealt = _parts(records, keys)
    row = F.struct(*([F.col(group).alias("g")] if group else []), F.col("next_lsn").alias("end"))
    last = dealt.groupBy("_part").agg(F.max_by(row, F.struct(*keys)).alias("_last"))
    before = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    own = F.lag(row).over(Window.partitionBy("_part").orderBy(*keys))
    seen = dealt.withColumn("_own", own).join(before, "_part").withColumn("_seen", F.coalesce("_own", "_before"))
    same = F.col("_seen.g") == F.col(group) if group else F.lit(True)
    return seen.withColumn("previous_end", F.when(same, F.col("_seen.end"))).drop("_part", "_own", "_before", "_seen").where("previous_end <> lsn")


def durable_at(events: DataFrame, key: str, order: str, is_sync: Column) -> DataFrame:
    """``durable_at``: the first sync at or after each record of its ``key``, null if none follows.

    Inside ranges of (key, order), then from the first sync of a later range
    that begins with the key: one row a range goes through a window.
    """
    dealt = _parts(events.withColumn("_sync", F.when(is_sync, F.col(order))), [key, order])
    own = F.min("_sync").over(Window.partitionBy("_part", key).orderBy(order).rowsBetween(0, Window.unboundedFollowing))
    ends = dealt.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    first = dealt.join(ends.select("_part", F.col("low").alias(key)), ["_part", key]).groupBy("_part", key).agg(F.min("_sync").alias("sync"))
    seen = first.union(ends.select("_part", F.col("high").alias(key), F.lit(None).cast(events.schema[order].dataType)))
    later = F.min("sync").over(Window.partitionBy(key).orderBy("_part").rangeBetween(1, Window.unboundedFollowing))
    later = seen.withColumn("_later", later).groupBy("_part", key).agg(F.min("_later").alias("_later"))
    return dealt.withColumn("_own", own).join(later, ["_part", key], "left").withColumn("durable_at", F.coalesce("_own", "_later")).drop("_part", "_sync", "_own", "_later")


def _first(events: DataFrame, key: str, order: Column, when: Column) -> DataFrame:
    """(key, _first): the least ``order`` where ``when`` holds, null if nowhere; partial minima, no sort."""
    return events.groupBy(key).agg(F.min(F.when(when, order)).alias("_first"))


def contiguous_frontier(events: DataFrame, key: str, order: str, done: Column, size: Column) -> DataFrame:
    """End of the longest prefix of finished writes, per ``key``: what lies before the first unfinished one."""
    joined = events.withColumn("_size", size).join(_first(events, key, F.col(order), ~done), key)
    before = F.col("_first").isNull() | (F.col(order) < F.col("_first"))
    return joined.groupBy(key).agg(F.coalesce(F.sum(F.when(before, F.col("_size"))), F.lit(0)).cast("long").alias("frontier"), F.count_if(before).alias("finished"))


def poisoned(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Per ``key``: records accepted up to the first failure, and rejected after it (sticky)."""
    joined = events.join(_first(events, key, F.col(order), failed), key)
    after = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return joined.groupBy(key).agg(F.count_if(~after).alias("accepted"), F.count_if(after).alias("rejected"))


def torn_tails(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """What a log cut at each offset of ``cuts`` holds: records, clean_end and the state of its tail; an offset past the end cuts nothing.

    Cuts are put among the ends of records, and count what comes before them.
    """
    ends = records.select(F.col("next_lsn").alias("at"), F.lit(0).alias("is_cut"), F.lit(1).alias("one"), F.col("next_lsn").alias("end"))
    asked = cuts.select("cut", F.lit(1), F.lit(0), F.lit(None).cast("long"))
    placed = running(running_total(ends.union(asked), ["at", "is_cut"], "one", "records"), ["at", "is_cut"], "end", "clean_end", F.max, F.greatest)
    out = placed.where("is_cut = 1").select(F.col("at").alias("cut"), "records", F.coalesce("clean_end", F.lit(0)).alias("clean_end"))
    last = F.broadcast(frontier(records).withColumnRenamed("lsn", "_end"))  # one row
    left = F.least("cut", "_end") - F.col("clean_end")
    return out.join(last).withColumn("state", F.when(left == 0, "CleanEnd").when(left < 8, "TruncatedHeader").otherwise("TruncatedPayload")).drop("_end")


def stored(records: DataFrame, path: str) -> DataFrame:
    """Writes placed records (with lsn and next_lsn) in ranges of lsn and reads them back; a filter on lsn then reads only the files and row groups that can hold it."""
    records.repartitionByRange("lsn").sortWithinPartitions("lsn").write.mode("overwrite").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path)


def scan(log: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Records of a stored log from ``start`` on, up to ``end``; the bounds reach the files."""
    found = log.where(F.col("lsn") >= start)
    return found if end is None else found.where(F.col("lsn") < end)


def lookup(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The record at each lsn of ``wanted`` and its state: Ok, InvalidData (no record starts there) or UnexpectedEof (at or past the log's end)."""
    end = F.broadcast(frontier(log).withColumnRenamed("lsn", "_end"))  # one row
    found = wanted.join(log.withColumn("_there", F.lit(True)), "lsn", "left").join(end)
    state = F.when(F.col("_there"), "Ok").when(F.col("lsn") >= F.col("_end"), "UnexpectedEof").otherwise("InvalidData")
    return found.withColumn("state", state).drop("_there", "_end")


def frame_header_hex(payload: Column) -> Column:
    """The 8 header bytes: magic in big-endian order, length in little-endian order."""
    n = F.octet_length(payload)
    little = [F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(0xFF)), 2, "0") for k in range(4)]
    return F.lower(F.concat(F.lit("46535901"), *little))
