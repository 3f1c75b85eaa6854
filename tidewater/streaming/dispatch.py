"""Queued batches of file operations, applied as they come and drained to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import batch


def drain(ops: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what is queued in ``ops`` now, in the portions that the source's limits make, applies the batches in each, and ends.

    Outcomes and files go to ``path`` under the number of the portion, which
    overwrites what a crash left of it, so a portion that is run again counts
    once. A batch must come in one portion.
    """

    def run(portion: DataFrame, number: int) -> None:
        files, done = batch.apply_ops(portion, key, order)
        for name, rows in (("files", files), ("outcomes", done)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/portion={number}")

    return ops.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
