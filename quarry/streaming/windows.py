"""Event-time windows over a stream of (ts, key, value): tumbling, sliding, session; and a limiter with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _aggregates(value: str):
    return F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total")


def tumbling(df: DataFrame, ts: str, key: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    rows = _timed(df, ts, late).groupBy(F.window(ts, width), key).agg(*_aggregates(value))
    return rows.select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(df: DataFrame, ts: str, key: str, value: str, width: str, step: str, late: str = "1 hour") -> DataFrame:
    rows = _timed(df, ts, late).groupBy(F.window(ts, width, step), key).agg(*_aggregates(value))
    return rows.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(df: DataFrame, ts: str, key: str, value: str, gap: str, late: str = "1 hour") -> DataFrame:
    rows = _timed(df, ts, late).groupBy(F.session_window(ts, gap), key).agg(*_aggregates(value))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n", "total")


def limited(df: DataFrame, ts: str, key: str, tokens: str, seconds: int, most_requests: int, most_tokens: int) -> DataFrame:
    """(key, ts, tokens, wait): the wait each request needs for the limits of its key's sliding window, ends included; the key's recent requests are the state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("t")
        out = []
        for t, n in zip(rows["t"], rows["n"]):
            wait = 0.0
            if len(times) >= most_requests and t - times[-most_requests] <= seconds:
                wait = seconds - (t - times[-most_requests])
            used = n
            for was, m in zip(reversed(times), reversed(sizes)):
                if t - was > seconds:
                    break
                used += m
                if used >= most_tokens:
                    wait = max(wait, seconds - (t - was))
                    break
            out.append((k[0], t, n, wait))
            times.append(t)
            sizes.append(n)
        times, sizes = zip(*[(a, b) for a, b in zip(times, sizes) if times[-1] - a <= seconds])
        state.update((list(times), list(sizes)))
        yield pd.DataFrame(out, columns=["key", "t", "n", "wait"])

    rows = df.select(F.col(key).cast("long").alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(tokens).cast("long").alias("n"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, t double, n long, wait double", "times array<double>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)
