"""Sliding-window accounts of requests: counts, sums, and the wait that limits would ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """df with recent: rows of the key in the `seconds` up to each row, ends included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count(F.lit(1)).over(w))


def window_sums(df: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.sum(value).over(w))


def waits(df: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """df with wait: seconds until the `most`-th row before leaves the window, 0 if it has."""
    w = Window.partitionBy(key).orderBy(ts, order)
    since = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts, most).over(w).cast("timestamp"))) / 1e6
    return df.withColumn("wait", F.when(since <= seconds, seconds - since).otherwise(F.lit(0.0)))
