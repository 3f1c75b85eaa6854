"""File contents as binary columns, and upserts keyed by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_at(content: Column, offset: int, n: int) -> Column:
    """Bytes [offset, offset + n), clamped to the content."""
    return F.substring(content, offset + 1, n)


def _rest(content: Column, at: int) -> Column:
    return F.substr(content, F.lit(at + 1))


def _zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def write_at(content: Column, offset: int, data: bytes) -> Column:
    """Overwrites bytes in place; a gap past the end reads zero."""
    gap = F.greatest(F.lit(0), F.lit(offset) - F.octet_length(content))
    return F.concat(F.substring(content, 1, offset), _zeros(gap), F.lit(data), _rest(content, offset + len(data)))


def truncate(content: Column, size: int) -> Column:
    """Shrinks, or extends with zeros."""
    return F.concat(F.substring(content, 1, size), _zeros(F.greatest(F.lit(0), F.lit(size) - F.octet_length(content))))


def zero_range(content: Column, offset: int, n: int) -> Column:
    """Zeros a range without changing the size."""
    inside = F.greatest(F.lit(0), F.least(F.lit(n), F.octet_length(content) - offset))
    return F.concat(F.substring(content, 1, offset), _zeros(inside), _rest(content, offset + n))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, keep: list[str]) -> DataFrame:
    """Replaces ``value`` by key and keeps untouched rows; columns of ``keep`` stay as they were (new rows have nulls)."""
    joined = old.select(key, F.col(value).alias("_old"), *keep).join(new.select(key, F.col(value).alias("_new")), key, "full")
    return joined.select(key, F.coalesce("_new", "_old").alias(value), *keep)


def append_all(old: DataFrame, appends: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, data) after the appends in ``order``; missing files begin empty. A file is one value, so its pieces meet in one row."""
    pieces = appends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, data)))[data].alias("_pieces"))
    joined = old.select(key, F.col(data).alias("_old")).join(pieces, key, "full")
    grown = F.aggregate(
        F.coalesce("_pieces", F.array().cast(f"array<{appends.schema[data].dataType.simpleString()}>")),
        F.coalesce(F.col("_old"), F.lit("").cast(old.schema[data].dataType)), lambda a, x: F.concat(a, x)
    )
    return joined.select(key, grown.alias(data))


def _made(tree: DataFrame, moves: DataFrame, key: str, rest: list[str]) -> DataFrame:
    """(key, rest) of each target; of several sources the last by ``order`` wins, or the greatest where moves have none."""
    last = F.struct(*(["order"] if "order" in moves.columns else []), "src")
    made = tree.join(moves, tree[key] == moves["src"]).select(F.col("dst"), last.alias("_last"), F.struct(*(tree[c] for c in rest)).alias("_row"))
    return made.groupBy("dst").agg(F.max_by("_row", "_last").alias("x")).select(F.col("dst").alias(key), *(F.col(f"x.{c}").alias(c) for c in rest))


def copy(tree: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Copies (src, dst[, order]) of ``moves``, all at once from the tree as it was: sources stay, targets are replaced, copies of nothing do nothing."""
    rest = [c for c in tree.columns if c != key]
    made = _made(tree, moves, key, rest)
    return tree.join(made.select(key), key, "left_anti").select(key, *rest).union(made)


def rename(tree: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Renames (src, dst[, order]) of ``moves``, all at once from the tree as it was, so swaps work: sources go, targets are replaced, renames of nothing do nothing."""
    rest = [c for c in tree.columns if c != key]
    made = _made(tree, moves, key, rest)
    gone = made.select(key).union(moves.select("src")).distinct()
    return tree.join(gone, key, "left_anti").select(key, *rest).union(made)


def delete(tree: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """The tree without the keys of ``doomed``; missing ones are no error."""
    return tree.join(doomed.select(key), key, "left_anti").select(tree.columns)


def exists(wanted: DataFrame, tree: DataFrame, key: str, is_file: Column | None = None) -> DataFrame:
    """``wanted`` with ``exists``: whether it is in the tree, as a regular file where ``is_file`` is given."""
    there = (tree if is_file is None else tree.where(is_file)).select(key).distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def meta(tree: DataFrame, key: str, content: Column, is_file: Column) -> DataFrame:
    """(key, size, is_file, is_dir): directories have size 0."""
    return tree.select(key, F.when(is_file, F.octet_length(content)).otherwise(0).cast("long").alias("size"), is_file.alias("is_file"), (~is_file).alias("is_dir"))
