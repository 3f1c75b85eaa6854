"""Ordered batches of file operations: stop at the first failure, earlier operations stay, the last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut
from .log import running_total


def outcomes(ops: DataFrame, batch: str, order: list[Column], failed: Column, error: Column | None = None) -> DataFrame:
    """Per batch: operations, completed before the first failure, and its index (null: none failed).

    With ``error``, also the ``error_code`` of that failure. A batch is never
    sorted: the index is the number of operations before the first failure.
    """
    marked = ops.select(batch, F.struct(*order).alias("at"), failed.alias("failed"), (F.lit(None).cast("string") if error is None else error).alias("error"))
    first = marked.where("failed").groupBy(batch).agg(F.min("at").alias("first"), F.min_by("error", "at").alias("error_code"))
    joined = marked.join(first, batch, "left")
    out = joined.groupBy(batch).agg(
        F.count("*").alias("ops"), F.count_if(F.col("at") < F.col("first")).alias("_before"), F.bool_or(F.col("first").isNotNull()).alias("_any"),
        F.max("error_code").alias("error_code")
    )
    out = out.withColumn("failed_at", F.when(F.col("_any"), F.col("_before"))).withColumn("completed", F.coalesce("failed_at", "ops")).drop("_any", "_before")
    return out if error is not None else out.drop("error_code")


def build(rows: DataFrame, kind: str, path: Column, src: Column | None = None, data: Column | None = None) -> DataFrame:
    """Operations of one kind (write, delete, copy) from rows that keep their other columns; union builders to mix kinds."""
    none = F.lit(None)
    return rows.select(
        "*", F.lit(kind).alias("kind"), path.alias("path"), (none if src is None else src).cast("string").alias("src"),
        (none if data is None else data).cast("string").alias("data")
    )


def last_write_wins(ops: DataFrame, path: str, order: str, deleted: Column) -> DataFrame:
    """The live operation of each path: its last one, unless that deletes."""
    last = ops.withColumn("_deleted", deleted).groupBy(path).agg(F.max_by(F.struct(*ops.columns, "_deleted"), F.col(order)).alias("x"))
    return last.where("not x._deleted").select(*(F.col(f"x.{c}") for c in ops.columns))


def grouped_parents(ops: DataFrame, batch: str, parent: str) -> DataFrame:
    """Directory syncs of a batch: one per operation, or one per distinct parent."""
    return ops.groupBy(batch).agg(F.count("*").alias("ops"), F.count_distinct(parent).alias("parents"))


def preflight(ops: DataFrame, batch: str, order: str, escapes: Column) -> DataFrame:
    """Per batch: rejected before anything runs if any of its paths escapes."""
    out = ops.groupBy(batch).agg(F.count("*").alias("ops"), F.min(F.when(escapes, F.col(order))).alias("first_escape"))
    return out.withColumns({"rejected": F.col("first_escape").isNotNull(), "completed": F.when(F.col("first_escape").isNull(), F.col("ops")).otherwise(F.lit(0).cast("long"))})


def apply_ops(ops: DataFrame, batch: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(files, outcomes) of batches of writes, deletes and copies on an empty tree.

    ``ops`` has ``kind`` (write, delete, copy), ``path``, ``src`` and ``data``; ``order`` is unique in a batch.
    A copy reads what its source holds just then, so it points to the last
    operation on that path before it. Pointers to other copies are followed by
    doubling, which takes as many joins as the logarithm of the longest chain.
    Operations are numbered by ranges of (batch, order), so a batch of any size
    spreads over tasks; those on one path of a batch meet in one. A copy of nothing fails and ends its batch.
    files: batch, path, origin (the write whose data it holds), data. outcomes:
    batch, ops, failed_at (null: none failed), completed, by number in the batch.
    """
    touched = ops.select(batch, F.col(order).alias("at"), F.col("path").alias("place"), F.lit(1).alias("touch"))
    reads = ops.where("kind = 'copy'").select(batch, F.col(order).alias("at"), F.col("src").alias("place"), F.lit(0).alias("touch"))
    earlier = Window.partitionBy(batch, "place").orderBy("at", "touch").rowsBetween(Window.unboundedPreceding, -1)
    seen = touched.union(reads).withColumn("from", F.last(F.when(F.col("touch") == 1, F.col("at")), ignorenulls=True).over(earlier))
    target = seen.where("touch = 0").select(batch, F.col("at").alias(order), "from")
    numbered = cut(running_total(ops.select(batch, order, "kind", "path", F.lit(1).alias("one")), [batch, order], "one", "pos"))
    kept = numbered.join(numbered.groupBy(batch).agg(F.min("pos").alias("_base")), batch).withColumn("op_idx", (F.col("pos") - F.col("_base")).cast("long"))
    # state: write, delete or nothing are settled; copy points on
    state = F.when(F.col("kind") != "copy", F.col("kind")).when(F.col("from").isNull(), "nothing").otherwise("copy")
    step = cut(kept.join(target, [batch, order], "left").select(batch, order, "kind", "path", "op_idx", state.alias("state"), F.coalesce("from", order).alias("origin")))
    while not step.where("state = 'copy'").isEmpty():
        ahead = step.select(batch, F.col(order).alias("_at"), F.col("state").alias("_state"), F.col("origin").alias("_origin"))
        settled, open_ = step.where("state <> 'copy'"), step.where("state = 'copy'")
        moved = open_.join(ahead, (open_[batch] == ahead[batch]) & (F.col("origin") == F.col("_at"))).select(
            open_[batch], order, "kind", "path", "op_idx", F.col("_state").alias("state"), F.col("_origin").alias("origin")
        )
        step = cut(settled.unionByName(moved))
    fails = (F.col("kind") == "copy") & F.col("state").isin("nothing", "delete")
    done = step.groupBy(batch).agg(F.count("*").alias("ops"), F.min(F.when(fails, F.col("op_idx"))).alias("failed_at")).withColumn("completed", F.coalesce("failed_at", "ops"))
    last = step.join(done.select(batch, "completed"), batch).where("op_idx < completed").groupBy(batch, "path").agg(F.max_by(F.struct("state", "origin"), "op_idx").alias("x"))
    live = last.where("x.state = 'write'").select(batch, "path", F.col("x.origin").alias("origin"))
    return live.join(ops.select(batch, F.col(order).alias("origin"), "data"), [batch, "origin"]).select(batch, "path", "origin", "data"), done


def shard(first_path: Column, n: int) -> Column:
    """The shard of a batch; batches that begin with the same path share one."""
    return F.pmod(F.xxhash64(first_path), F.lit(n)).cast("int")
