"""Streaming forms of the rate window, the caches' and sessions' expiry, and incremental ingest (section 2.10, N-07, C-01, C-09, Z-14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def request_windows(events: DataFrame, by: str, at: str, seconds: int = 60, slide: int | None = None, late: str = "10 minutes") -> DataFrame:
    """N-07 over a stream: requests in each window and key; rows later than ``late`` are dropped, so state stays bounded."""
    w = F.window(F.col(at), f"{seconds} seconds", f"{slide or seconds} seconds")
    counted = events.withWatermark(at, late).groupBy(w.alias("w"), F.col(by)).agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "requests")


def over_limit(windows: DataFrame, most: int) -> DataFrame:
    """Windows in which a key made more requests than allowed."""
    return windows.where(F.col("requests") > most)


def first_seen(events: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """W-01 over a stream: the first row of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def user_sessions(events: DataFrame, by: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after ``gap`` without a row: start, end, number of rows."""
    w = F.session_window(F.col(at), gap)
    counted = events.withWatermark(at, late).groupBy(w.alias("w"), F.col(by)).agg(F.count("*").alias("events"))
    return counted.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def latest_response(events: DataFrame, by: str, value: str, at: str, alpha: float = 0.1, forget: str = "1 day") -> DataFrame:
    """A-19 over a stream: exponential mean of ``value`` for each key, kept as state until ``forget`` passes without a row.

    Rows of one key are taken in order of time within a micro-batch.
    """
    out = f"{by} string, ema double, n long"
    ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mean, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for x in rows["value"].dropna():
            mean = float(x) if mean is None else (1 - alpha) * mean + alpha * float(x)
            n += 1
        state.update((mean, n))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame({by: [str(key[0])], "ema": [mean], "n": [n]})

    keyed = events.select(F.col(by).cast("string").alias(by), F.col(value).cast("double").alias("value"), F.col(at).alias("at"))
    return keyed.groupBy(by).applyInPandasWithState(update, out, "mean double, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """W-01 ... W-11 micro-batch by micro-batch: ``store(batch, batch_id)`` runs the batch forms; replays keep their batch_id, so a store can be idempotent."""
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
