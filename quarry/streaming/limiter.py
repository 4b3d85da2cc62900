"""A limiter over a stream with state that goes away: requests in event-time order, whatever micro-batch brings them.

Rows wait in their key's state until the watermark has passed them, then they are taken in the order of
their times. The state holds what waits and what the window still needs; timers empty it once a key is
idle for a window's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key long, id long, t double, n long, wait double"


def wait_for(t: float, n: int, recent: list[tuple[float, int]], seconds: float, most_requests: int, most_tokens: int) -> float:
    """How long a request of n tokens at t has to wait; recent: (time, tokens) of earlier ones in order; the window's ends count, and tokens that reach the limit block."""
    inside = [(s, m) for s, m in recent if t - s <= seconds]
    wait = 0.0
    if len(inside) >= most_requests:
        wait = seconds - (t - inside[-most_requests][0])
    used = n
    for s, m in reversed(inside):
        used += m
        if used >= most_tokens:
            return max(wait, seconds - (t - s))
    return wait


class Limiter(StatefulProcessor):
    def __init__(self, seconds: float, most_requests: int, most_tokens: int):
        self.limits = seconds, most_requests, most_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, n long, id long")
        self.recent = handle.getListState("recent", "t double, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(float(t), int(n), int(i)) for some in rows for t, n, i in zip(some["t"], some["n"], some["id"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(ceil(max(t for t, _, _ in new) * 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000  # nothing older comes any more
        seconds = self.limits[0]
        waiting = sorted(tuple(x) for x in self.waiting.get())
        recent = [tuple(x) for x in self.recent.get()]
        out = []
        for t, n, i in [x for x in waiting if x[0] <= now]:
            out.append((key[0], i, t, n, wait_for(t, n, recent, *self.limits)))
            recent = [x for x in recent if t - x[0] <= seconds] + [(t, n)]
        later = [x for x in waiting if x[0] > now]
        recent = [x for x in recent if now - x[0] <= seconds]
        for state, rows in ((self.waiting, later), (self.recent, recent)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if recent:
            self.handle.registerTimer(ceil((recent[-1][0] + seconds) * 1000) + 1)
        return iter([pd.DataFrame(out, columns=["key", "id", "t", "n", "wait"])] if out else ())

    def close(self) -> None:
        pass


def limited_in_order(df: DataFrame, ts: str, key: str, row: str, tokens: str, seconds: int, most_requests: int, most_tokens: int, late: str = "1 hour") -> DataFrame:
    """(key, id, t, n, wait): the wait that each request needs so that its key's requests and tokens stay within the limits of a sliding window.

    A row comes out once the watermark has passed it, rows later than `late` are dropped. Rows of one time
    go by tokens, then by row. Null keys, rows, times and tokens are no requests. The session's state
    store has to be PROVIDER, as timers need it.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(row).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("at"), F.col(tokens).cast("long").alias("n"))
    rows = rows.where("key is not null and id is not null and at is not null and n is not null").withColumn("t", F.unix_micros("at") / 1e6).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Limiter(seconds, most_requests, most_tokens), OUT, "Append", "EventTime")
