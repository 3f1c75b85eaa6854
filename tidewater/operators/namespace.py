"""Queries over a table of paths: list, scan, glob, count, missing ancestors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PATTERNS = 1024


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Every proper prefix directory of a relative path; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))


def list_dir(paths: DataFrame, directory: str) -> DataFrame:
    return paths.where(parent(F.col("path")) == directory)


def scan_all(paths: DataFrame, directory: str) -> DataFrame:
    return paths.where(F.col("path").startswith(directory + "/")) if directory else paths


def count_all(paths: DataFrame, is_file: Column) -> DataFrame:
    """Regular files directly in, and at or below, every directory: partial sums before the shuffle."""
    up = paths.where(is_file).select(F.explode(ancestors(F.col("path"))).alias("dir"), parent(F.col("path")).alias("own"))
    return up.groupBy("dir").agg(F.sum((F.col("dir") == F.col("own")).cast("long")).alias("n_direct"), F.count("*").alias("n_all"))


def missing_ancestors(paths: DataFrame) -> DataFrame:
    """Directories that paths lie in but that are not in the table themselves."""
    need = paths.select(F.explode(ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    return need.join(paths.select("path"), "path", "left_anti")


def expand_braces(pattern: str) -> list[str]:
    """``{a,b}`` alternatives multiplied out: from the first brace to the next closing one, so nesting is not understood; MOST_PATTERNS at most."""
    done, open_ = [], [pattern]
    while open_ and len(done) < MOST_PATTERNS:
        p = open_.pop()
        head, brace, rest = p.partition("{")
        inside, closed, tail = rest.partition("}")
        if brace and closed:
            open_ += [head + x + tail for x in reversed(inside.split(","))]
        else:
            done.append(p)
    return done


def components(pattern: str) -> list[str]:
    return [c for c in pattern.split("/") if c not in ("", ".")]


def _component_regex(part: str) -> str:
    """One path component: ``*``, ``?`` and classes (``[a-z]``, negated by ``!``; a closing bracket in front is a member)."""
    if "**" in part:
        raise ValueError("** must be a whole component")
    out, k = [], 0
    while k < len(part):
        c = part[k]
        if c == "[":
            negated = part[k + 1 : k + 2] == "!"
            first = k + 1 + negated
            end = part.find("]", first + 1)
            if end < 0:
                raise ValueError("class without an end")
            members = "".join(f"{re.escape(m[0])}-{re.escape(m[2])}" if len(m) == 3 else re.escape(m) for m in re.findall(r".-.|.", part[first:end], re.S))
            out.append(f"(?![/])[{'^' if negated else ''}{members}]")
            k = end
        else:
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        k += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: wildcards stay inside a component, ``**`` spans any number of them."""
    out, parts = [], components(pattern)
    if all(p == "**" for p in parts):
        return "^.*$" if parts else "^$"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append(".+" if last else "(?:[^/]+/)*")
        else:
            out.append(_component_regex(part) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def find(paths: DataFrame, pattern: str, is_dir: Column | None = None) -> DataFrame:
    """Paths that match a glob with braces.

    A pattern that ends in ``**`` matches directories only (``is_dir``; without
    it, no path is known to be one, and all match). A pattern of nothing or of
    ``**`` alone matches the root, the path "", where the table lists it.
    Patterns with ".." anywhere and absolute ones are refused.
    """
    if pattern.startswith("/") or ".." in pattern:
        raise ValueError("pattern escapes the root")
    any_, dirs = [], []
    for p in expand_braces(pattern):
        (dirs if components(p)[-1:] == ["**"] else any_).append(f"(?:{glob_regex(p)})")
    match = lambda some: F.col("path").rlike("|".join(some)) if some else F.lit(False)
    return paths.where(match(any_) | (match(dirs) & (F.lit(True) if is_dir is None else is_dir)))


def depth_first(paths: DataFrame) -> DataFrame:
    """Parents before their children, siblings by name."""
    return paths.orderBy(F.split("path", "/"))


def make_dirs(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """What becomes of each directory of ``wanted`` (path): made, or an error since it exists or its parent does not; asked for twice, it exists the second time."""
    once = wanted.groupBy("path").agg(F.count("*").alias("asked")).withColumn("up", parent(F.col("path")))
    there = paths.select("path").withColumn("there", F.lit(True))
    up = paths.where("not is_file").select(F.col("path").alias("up")).withColumn("has_parent", F.lit(True))
    state = F.when(F.col("there"), "AlreadyExists").when((F.col("up") != "") & F.col("has_parent").isNull(), "NotFound").otherwise("made")
    out = once.join(there, "path", "left").join(up, "up", "left").select("path", "asked", state.alias("state"))
    return out.select("path", "state", F.when(F.col("state") == "made", F.col("asked") - 1).otherwise(F.col("asked")).alias("errors"))


def scan_partial(paths: DataFrame, directory: str, unreadable: DataFrame) -> DataFrame:
    """Everything below a directory but what lies below unreadable ones (path), which are listed themselves with ``failed``."""
    found = scan_all(paths, directory)
    bad = unreadable.select(F.col("path").alias("_up")).distinct()
    up = found.select("path", F.explode(ancestors(F.col("path"))).alias("_up"))
    hidden = up.join(bad, "_up", "left_semi").select("path").distinct()
    seen = found.join(hidden, "path", "left_anti")
    return seen.join(bad.select(F.col("_up").alias("path"), F.lit(True).alias("failed")), "path", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def remove_empty(paths: DataFrame, doomed: DataFrame, is_file: Column) -> DataFrame:
    """The tree without those directories of ``doomed`` (path) that hold nothing; the others stay, missing ones are no error."""
    full = paths.select(parent(F.col("path")).alias("path")).distinct()
    gone = doomed.join(full, "path", "left_anti").join(paths.where(~is_file).select("path"), "path", "left_semi")
    return paths.join(gone.select("path"), "path", "left_anti").select(paths.columns)


def remove_trees(paths: DataFrame, doomed: DataFrame) -> DataFrame:
    """The tree without the directories of ``doomed`` (path) and all below; an equality join on every ancestor, so no pairs are compared."""
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_up"))
    gone = up.join(doomed.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return paths.join(gone, "path", "left_anti").select(paths.columns)
