"""Table access, lineage cuts and connected components for this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import cut, folder

FILTER_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text), whatever else the input holds; null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def maybe_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows that may have their ``on`` values in ``keys``: a filter of 2^FILTER_BITS bits, broadcast, for use ahead of an exact join."""
    bit = F.xxhash64(*on, F.lit("bit")).bitwiseAND((1 << FILTER_BITS) - 1)
    bits = keys.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("_word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("_bit"))
    bits = cut(bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))  # 2^(FILTER_BITS - 6) rows at most
    seen = rows.withColumn("_at", bit).join(F.broadcast(bits), F.shiftright("_at", 6) == F.col("_word"))
    return seen.where(F.expr("(shiftright(_bits, cast(_at & 63 as int)) & 1) = 1")).select(rows.columns)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root): root is the smallest node reachable over ``edges`` (a, b), for nodes other than their root.

    Alternating large-star and small-star steps; each halves the depth of the
    forest at least, and only the edges of each step are shuffled. Hubs are
    aggregated map-side and joined back, never gathered in one task. Raises if
    the edges have not settled after ``most_rounds``.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


_tables: list[str] = []


@atexit.register
def _clean() -> None:
    """Drops this application's tables when it ends; stores that pyarrow doesn't know keep them in the checkpoint folder."""
    while _tables:
        with contextlib.suppress(Exception):
            store, place = fs.FileSystem.from_uri(_tables.pop())
            store.delete_dir(place)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage with a compressed Parquet table in the shared checkpoint folder; for rows that checkpoint() would store unpacked."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one, by (group, order).

    Two levels, so no task sees all rows: a window inside each group (a source
    partition or a block of ids), and one over the groups' sums.
    """
    sums = df.groupBy(group).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(group, "_before")
    own = F.coalesce(F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_own", own).join(before, group).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before")
