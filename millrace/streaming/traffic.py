"""Sessions, limiter, cache and request metrics over streams. All take a stream with event time `ts`; rows later than the watermark are dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.logs import limiter, metric_parts, replay

#: The setting that tail_stream needs: state in RocksDB.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def session_stream(events: DataFrame, key: str = "user_id", ttl: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions by gap, each emitted once it can no longer grow."""
    got = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", ttl).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("session_end"))
    return got.select(key, F.col("w.start").alias("session_start"), "session_end", "n")


def metrics_stream(requests: DataFrame, window: str = "1 hour", slow: float = 1.0, delay: str = "10 minutes") -> DataFrame:
    """Request metrics of tumbling windows, each emitted once it is closed, in the form that is stored: logs.merge_metrics makes days of them, logs.metric_values figures."""
    got = requests.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "path").agg(*metric_parts(slow))
    return got.select(F.col("w.start").alias("window_start"), *[c for c in got.columns if c != "w"])


def trailing_stream(requests: DataFrame, key: str = "client", window: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests of each client in sliding windows."""
    got = requests.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("window_start"), key, "n")


def _stepper(make_step, result: str, key: str, idle_ms: int):
    """Applies a fold's step to a key's rows in order of time. The step's times are the state; a key idle beyond the window loses it."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        held = [int(t) for t in state.get[0]] if state.exists else []
        step = make_step(held)
        us = rows["ts"].astype("datetime64[us]").astype("int64")
        done = [step(int(t)) for t in us]
        state.update((held,))
        state.setTimeoutTimestamp(max(int(us.max()) // 1000, state.getCurrentWatermarkMs()) + idle_ms + 1)
        yield pd.DataFrame({key: rows[key].to_numpy(), "event_id": rows["event_id"].to_numpy(), "ts": rows["ts"].to_numpy(), result: done})

    return run


def limiter_stream(requests: DataFrame, key: str = "client", most: int = 100, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """(key, event_id, ts, accepted). State: at most `most` times a client."""
    kind = dict(requests.dtypes)[key]
    run = _stepper(limiter(most, seconds * 1_000_000), "accepted", key, seconds * 1000)
    return requests.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, ts timestamp, accepted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def cache_stream(accesses: DataFrame, key: str = "cache_key", ttl_seconds: int = 3600, delay: str = "1 minute") -> DataFrame:
    """(key, event_id, ts, hit). State: the last write of a key."""
    kind = dict(accesses.dtypes)[key]
    run = _stepper(replay(ttl_seconds * 1_000_000), "hit", key, ttl_seconds * 1000)
    return accesses.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, ts timestamp, hit boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class SessionTail(StatefulProcessor):
    """The last messages of a session, and the time of the last; a timer of event time clears both when the session has ended."""

    def __init__(self, kept: int, ttl_us: int, key: str):
        self.kept, self.ttl, self.key = kept, ttl_us, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "role string, content string")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("ts", kind="stable")
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        us = got["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        for now, role, content in zip(us, got["role"], got["content"], strict=True):
            if last is not None and now - last >= self.ttl:
                held = []
            held, last = [*held, (role, content)][-self.kept :], now
        self.held.put(held)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((last + self.ttl) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({self.key: [key[0]], "n": [len(held)], "messages": [[{"role": r, "content": c} for r, c in held]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def tail_stream(messages: DataFrame, kept: int = 40, ttl_seconds: int = 86400, delay: str = "1 hour") -> DataFrame:
    """(session_id, n, messages) after each batch of a session's messages (session_id, ts, role, content): at most `kept`, dropped ttl_seconds after the last.

    State lies in RocksDB, which the session must name as its state store (STATE_STORE). A
    session holds at most `kept` messages, one time and one timer, and nothing once the
    watermark has passed its end.
    """
    kind = dict(messages.dtypes)["session_id"]
    return messages.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(
        SessionTail(kept, ttl_seconds * 1_000_000, "session_id"), f"session_id {kind}, n int, messages array<struct<role:string,content:string>>", "Append", "EventTime"
    )
