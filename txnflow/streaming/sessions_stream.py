"""W4, W5 on a stream: gap to the previous transaction and the session index.

``applyInPandasWithState`` keyed by actor.  The state of one actor is its
last emitted time, its current session index and a buffer of rows that are
newer than the watermark.  A row is emitted only once the watermark has
passed it -- rows older than the watermark are late data and Spark drops them
before they reach the state -- so rows leave in event-time order and the
emitted gaps and session indexes equal the batch operator's on the on-time
rows.  An event-time timeout at the oldest buffered row flushes an actor when
the watermark moves on without new rows for it.

State per actor is bounded by the rows of that actor inside the watermark
delay.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txnflow.operators.sessions import DAY
from txnflow.session import ship_package

OUTPUT_SCHEMA = ("actor_id string, action_epoch long, event string, gap_seconds long, clust_index int, "
                 "time_diff double")
STATE_SCHEMA = "last_time long, clust long, buf_time array<long>, buf_event array<string>"


def _sessionize(cut_seconds: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        actor = key[0]
        if state.exists:
            last_time, clust, buf_time, buf_event = state.get
        else:
            last_time, clust, buf_time, buf_event = None, 0, [], []
        parts = [pd.DataFrame({"t": np.asarray(buf_time or [], dtype=np.int64),
                               "event": pd.Series(buf_event or [], dtype=object)})]
        for b in batches:
            parts.append(pd.DataFrame({"t": b["action_epoch"].to_numpy(np.int64), "event": b["event"].astype(object)}))
        rows = pd.concat(parts, ignore_index=True).sort_values(["t", "event"], kind="mergesort")
        watermark = state.getCurrentWatermarkMs()
        ready = rows[rows["t"] * 1000 <= watermark] if watermark > 0 else rows.iloc[0:0]
        rest = rows.iloc[len(ready):]

        out = pd.DataFrame(columns=["actor_id", "action_epoch", "event", "gap_seconds", "clust_index",
                                    "time_diff"])
        if len(ready):
            t = ready["t"].to_numpy(np.int64)
            prev = np.concatenate([[t[0] if last_time is None else last_time], t[:-1]])
            gap = t - prev
            index = clust + np.cumsum(gap > cut_seconds)
            out = pd.DataFrame({"actor_id": actor, "action_epoch": t, "event": ready["event"].to_numpy(),
                                "gap_seconds": gap, "clust_index": index.astype(np.int32),
                                "time_diff": np.rint(gap / float(DAY) * 10000.0) / 10000.0})
            last_time, clust = int(t[-1]), int(index[-1])
        state.update((last_time, clust, rest["t"].tolist(), rest["event"].tolist()))
        if len(rest):
            state.setTimeoutTimestamp(int(rest["t"].iloc[0]) * 1000 + 1)
        yield out
    return run


def stream_gap_sessions(features: DataFrame, watermark: str | None = None, cut_seconds: int = DAY) -> DataFrame:
    """Streaming sessions over a feature stream with ``actor_id``, ``action_epoch`` and ``event``.

    The query's watermark must be on the event time (``action_epoch``).  A
    feature stream from :func:`feature_stream` already carries one (its dedup
    watermark); pass ``watermark`` only for a stream that has none.
    """
    ship_package(features.sparkSession)
    carried = ["event_time"] if watermark is None and "event_time" in features.columns else []
    rows = features.select("actor_id", "action_epoch", "event", *carried)
    if watermark is not None:
        rows = (rows.withColumn("event_time", F.timestamp_seconds("action_epoch"))
                    .withWatermark("event_time", watermark))
    return rows.groupBy("actor_id").applyInPandasWithState(
        _sessionize(cut_seconds), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
