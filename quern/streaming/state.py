"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.generation import MOVES, NOT_GENERATED, outcome

SESSIONS = "user_id long, event_id long, session int, opened timestamp"


def session_stream(events: DataFrame, ttl_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id, session, opened of a stream of (user_id, event_id, ts): a session ends ttl after it was opened.

    State is one number and one time a user, forgotten once the watermark has passed the session's end, so it does not grow
    with all users ever seen; sessions of a user that was forgotten are numbered from 1 again. Events of a batch are taken in
    order; one that comes later than another batch's is put into the session that is open then.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for t, e in zip(rows["ts"], rows["event_id"], strict=True):
            micros = t.value // 1000
            if n == 0 or opened + ttl_seconds * 1_000_000 <= micros:
                opened, n = micros, n + 1
            out.append((key[0], e, n, pd.Timestamp(opened * 1000)))
        state.update((opened, n))
        state.setTimeoutTimestamp(max(opened // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "session", "opened"])

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(step, SESSIONS, "opened long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def favourite_stream(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key of a stream with a time column ts; a key is forgotten once the watermark has passed it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and sum of value for each window and event_type."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value"))


class Explanations(StatefulProcessor):
    """The generation state of each key as one number; rows (order, action) of a batch are taken in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("order")
        state, before = int(self.now.get()[0]) if self.now.exists() else NOT_GENERATED, []
        for action in got["action"]:
            before.append(state)
            state = MOVES[action][state] if action in MOVES else state
        self.now.update((state,))
        yield pd.DataFrame({"key": key[0], "order": got["order"], "action": got["action"], "state": before})

    def close(self) -> None:
        """Nothing is held outside the state."""


def generation_stream(events: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, action, state, transition) of a stream of (by, order, action), as generation() gives it for a table.

    A key's events must come in order from batch to batch. State is a number a key and must outlive every pause, so it is not timed
    out. The session's state store must be RocksDB's, as value states need column families.
    """
    rows = events.select(F.col(by).alias("key"), F.col(order).alias("order"), "action")
    got = rows.groupBy("key").transformWithStateInPandas(Explanations(), "key long, order long, action string, state int", "append", "none")
    named = got.withColumn("transition", outcome(F.col("action"), F.col("state")))
    return named.withColumnsRenamed({"key": by, "order": order})
