"""Event streams: windows with watermarks, and rate limiting with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files that appear in the folder ``path`` (or match it); ``ts`` as a timestamp, as watermarks need it."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window and type: events and the sum of values.  On a plain table, the same without a watermark."""
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "1 day", every: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return _windowed(events, F.window("ts", width, every), late)


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Per user and session: start, end, events."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _windowed(events: DataFrame, window, late: str) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """``user_id, ts, allowed`` for each request; windows start at a client's first request.

    State is a client's window start and count; it is dropped when a window has been over
    for an hour.  Requests of one micro-batch are read in order of time.
    """
    length = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        times = sorted(t for pdf in batches for t in pdf["t"].tolist())
        allowed = []
        for t in times:
            if start is None or t - start >= length:
                start, n = t, 0
            allowed.append(n < limit)
            n += allowed[-1]
        state.update((start, n))
        state.setTimeoutDuration((seconds + 3600) * 1000)
        yield pd.DataFrame({"user_id": [key[0]] * len(times), "ts": pd.to_datetime(times, unit="us", utc=True).tz_localize(None) if times else [], "allowed": allowed})

    keyed = events.select("user_id", F.unix_micros("ts").alias("t"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, allowed boolean", "start long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_audit(events: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """A query that appends events as JSON lines, batch by batch."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def run_to_table(counts: DataFrame, path: str) -> None:
    """Bring a stream of aggregates to its end; each micro-batch replaces the table at ``path``/table by what holds then."""
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/table")
    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
