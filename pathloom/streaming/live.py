"""Streams of events: counts by time window, sessions of cases and live queues.

An extension; the batch operators have no counterpart of it.  Times are
``timestamp`` here (watermarks take no other kind) and read as UTC."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.schema import LOG, LogSchema


def timed(events: DataFrame, late: str = "1 hour", s: LogSchema = LOG) -> DataFrame:
    """Events with a watermark on their time."""
    return events.withColumn(s.time, F.col(s.time).cast("timestamp")).withWatermark(s.time, late)


def window_counts(events: DataFrame, width: str = "15 minutes", slide: str | None = None, late: str = "1 hour", s: LogSchema = LOG) -> DataFrame:
    """window_start, window_end, activity, n."""
    window = F.window(s.time, width, slide) if slide else F.window(s.time, width)
    out = timed(events, late, s).groupBy(window.alias("w"), s.activity).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), s.activity, "n")


def case_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour", s: LogSchema = LOG) -> DataFrame:
    """case, session_start, session_end, n: runs of a case's events without a
    gap of that length."""
    out = timed(events, late, s).groupBy(F.session_window(s.time, gap).alias("w"), s.case).agg(F.count(F.lit(1)).alias("n"))
    return out.select(s.case, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def queue_changes(events: DataFrame, late: str = "1 hour", open_stays: bool = False, s: LogSchema = LOG) -> DataFrame:
    """state, timestamp, delta: +1 where a case comes into a state and -1 where
    it leaves it, as soon as the watermark has passed.

    A case's state at a time is its last event there (by ``s.seq``).  A case
    keeps its last state and the events that the watermark hasn't passed yet.
    Both changes of a stay come when it ends, so a finished stream has those of
    ``queues.change_points``; with ``open_stays`` +1 comes when it begins, so the
    sum of deltas counts cases that still wait.  Events without a case, activity
    or time, and those that are later than ``late``, are left out."""
    rows = timed(events.dropna(subset=s.core), late, s).select(
        F.col(s.case).cast("string").alias("case"), F.col(s.activity).cast("string").alias("activity"),
        F.col(s.time).alias("at"), F.unix_micros(s.time).alias("us"), F.col(s.seq).cast("long").alias("seq"),
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, since, kept = state.get if state.exists else (None, None, "[]")
        waiting = [tuple(x) for x in json.loads(kept)]
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip(batch["us"].tolist(), batch["seq"].tolist(), batch["activity"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted(x for x in waiting if x[0] < passed)
        waiting = [x for x in waiting if x[0] >= passed]
        out = []
        for i, (us, _, activity) in enumerate(ready):
            if i + 1 < len(ready) and ready[i + 1][0] == us:
                continue
            if last is not None:
                out += [(last, us, -1)] if open_stays else [(last, since, 1), (last, us, -1)]
            if open_stays:
                out.append((activity, us, 1))
            last, since = activity, us
        state.update((last, since, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(x[0] for x in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["state", "us", "delta"]).astype({"us": "int64", "delta": "int32"})

    changes = rows.groupBy("case").applyInPandasWithState(
        step, "state string, us long, delta int", "last string, since long, waiting string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return changes.select("state", F.timestamp_micros("us").alias("timestamp"), "delta")
