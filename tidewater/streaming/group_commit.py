"""Group commit: sync requests gathered behind a leader until a deadline or enough followers.

In batch no task holds all requests of a key. Over a stream the state of a key
is one open commit (leader, time, followers), so memory does not grow with the
stream; rows of a key must arrive in order of ``ts``, and those of one
micro-batch are held together, so a limit on the source's triggers bounds them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.lineage import cut
from ..operators.log import running_total

BLOCK = 1 << 14  # rows of a block of positions, as long as a commit is shorter

_SCHEMA = "user_id long, event_id long, leader_id long, followers_before long"


def _assign(rows: pd.DataFrame, open_: tuple | None, window_s: float, most: int) -> tuple[pd.DataFrame, tuple | None, list[tuple]]:
    """(leaders of the rows, open commit, closed commits); a commit: (leader's id, leader's time in seconds, followers so far)."""
    out, closed = [], []
    for user, event, ts in rows[["user_id", "event_id", "ts"]].itertuples(index=False):
        now = ts.timestamp()
        if open_ is None or now >= open_[1] + window_s or open_[2] >= most:
            closed += [open_] if open_ else []
            open_ = (event, now, 0)
        else:
            open_ = (open_[0], open_[1], open_[2] + 1)
        out.append((user, event, open_[0], open_[2]))
    return pd.DataFrame(out, columns=["user_id", "event_id", "leader_id", "followers_before"]), open_, closed


def commits(requests: DataFrame, window_s: float, most_followers: int) -> DataFrame:
    """The commit (leader) of each request of (user_id, event_id, ts), in batch.

    All requests are numbered by user and time. If a request leads, the next
    leader is the earlier of the row ``most_followers`` + 1 after it and the
    first row outside its window, which a block of positions and the head of
    the block after it tell. Leaders are what these pointers reach from each
    user's first request, by doubling: joins by the logarithm of the longest chain.
    """
    most, wide = most_followers + 1, round(window_s * 1e6)
    block = max(BLOCK, most)
    plain = requests.select(
        F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("one")
    )
    rows = cut(running_total(plain, ["user_id", "at", "event_id"], "one", "pos").drop("one"))
    first = rows.groupBy("user_id").agg(F.min("pos").alias("pos")).select("pos")

    own = F.floor(F.col("pos") / block)
    ahead = rows.where((F.col("pos") % block < most) & (F.col("pos") >= block)).select("user_id", "at", "pos", (own - 1).alias("block"), F.lit(False).alias("own"))
    near = rows.select("user_id", "at", "pos", own.alias("block"), F.lit(True).alias("own")).union(ahead)
    if wide > 0:
        last = F.max("pos").over(Window.partitionBy("block", "user_id").orderBy("at").rangeBetween(0, wide - 1))
    else:
        last = F.col("pos")
    near = near.withColumn("last", F.least(last, F.col("pos") + most - 1)).where("own").select("pos", "last")
    near = cut(near)

    leaders = cut(first)
    jump = cut(near.select("pos", (F.col("last") + 1).alias("to")).join(first.withColumnRenamed("pos", "to"), "to", "left_anti"))
    while not jump.isEmpty():
        leaders = cut(leaders.union(leaders.join(jump, "pos").select("to")))
        jump = cut(jump.join(jump.select(F.col("pos").alias("to"), F.col("to").alias("_to")), "to").select("pos", F.col("_to").alias("to")))

    led = leaders.join(near, "pos").join(rows.select("pos", F.col("event_id").alias("leader_id")), "pos")
    led = led.select("leader_id", F.col("pos").alias("_lead"), F.explode(F.sequence("pos", "last")).alias("pos"))
    return rows.join(led, "pos").select("user_id", "event_id", "leader_id", (F.col("pos") - F.col("_lead")).alias("followers_before"))


def stream_commits(requests: DataFrame, window_s: float, most_followers: int) -> DataFrame:
    """The same over a stream; the open commit of a user lives in the state store."""

    def run(key, batches, state):
        open_ = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, open_, _ = _assign(rows, open_, window_s, most_followers)
        state.update(open_)
        yield out

    return requests.groupBy("user_id").applyInPandasWithState(run, _SCHEMA, "leader_id long, at double, followers long", "append", GroupStateTimeout.NoTimeout)


def stream_syncs(requests: DataFrame, window_s: float, most_followers: int) -> DataFrame:
    """One event a commit over a stream with a watermark on ``ts``: (user_id, leader_id, followers), by its leader only.

    A commit closes when it is full, when a request comes after its window, or,
    if none comes, when the watermark passes its deadline.
    """

    def run(key, batches, state):
        open_ = state.get if state.exists else None
        if state.hasTimedOut:
            closed, open_ = [open_], None
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            _, open_, closed = _assign(rows, open_, window_s, most_followers)
        if open_ is None:
            state.remove()
        else:
            if open_[2] >= most_followers:
                closed.append(open_)
                state.remove()
            else:
                state.update(open_)
                state.setTimeoutTimestamp(max(int((open_[1] + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], leader, n) for leader, _, n in closed], columns=["user_id", "leader_id", "followers"])

    return requests.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, leader_id long, followers long", "leader_id long, at double, followers long", "append", GroupStateTimeout.EventTimeTimeout
    )
