"""Requests in batches that close by number or by time, as a stream with timers and on a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusql.operators import governance

CLOSED = "client long, opened timestamp, n int, closed_by string, ids array<long>"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Batcher(StatefulProcessor):
    """A client's requests that wait for the watermark, and the batch that is open.

    Requests count in order of time, so they wait until nothing earlier can come.  A timer
    wakes the client when the next of them may count, or the open batch has waited long
    enough.  A client with neither has no state.
    """

    def __init__(self, size: int, wait_us: int):
        self.size, self.wait_us = size, wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", "t long, id long")
        self.open = handle.getListState("open", "t long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [x for pdf in rows for x in zip(pdf["t"].tolist(), pdf["id"].tolist())]
        yield from self.advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key, new: list[tuple[int, int]], watermark_ms: int) -> Iterator[pd.DataFrame]:
        now = watermark_ms * 1000
        waiting = sorted([tuple(x) for x in self.early.get()] + new)
        ready = [x for x in waiting if x[0] <= now]
        waiting = waiting[len(ready) :]
        held, closed = [tuple(x) for x in self.open.get()], []

        def close(by: str) -> None:
            closed.append((key[0], pd.Timestamp(held[0][0], unit="us"), len(held), by, [i for _, i in held]))
            held.clear()

        for t, i in ready:
            if held and t - held[0][0] >= self.wait_us:
                close("wait")
            held.append((t, i))
            if len(held) == self.size:
                close("size")
        if held and now - held[0][0] >= self.wait_us:
            close("wait")
        for state, rows in ((self.early, waiting), (self.open, held)):
            state.put(rows) if rows else state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wake = [-(-x[0][0] // 1000) for x in (waiting, [(held[0][0] + self.wait_us, 0)] if held else []) if x]
        if wake:
            self.handle.registerTimer(max(min(wake), watermark_ms + 1))
        if closed:
            yield pd.DataFrame(closed, columns=["client", "opened", "n", "closed_by", "ids"])

    def close(self) -> None:
        pass


def batches(requests: DataFrame, size: int = 50, wait_us: int = 100_000, late: str = "10 minutes") -> DataFrame:
    """A stream of closed batches from a stream of ``client, id, ts``: ``client, opened, n, closed_by, ids``.

    A batch closes with ``size`` requests, or ``wait_us`` after its first.  Requests that
    come more than ``late`` behind are dropped.  Start it inside ``rocks``.
    """
    rows = requests.where("client is not null and id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select(F.col("client").cast("long").alias("client"), F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("client").transformWithStateInPandas(Batcher(size, wait_us), CLOSED, "Append", "EventTime")


def closed_batches(requests: DataFrame, until: Column, size: int = 50, wait_us: int = 100_000) -> DataFrame:
    """The same from a table, as a stream whose watermark is ``until`` has them."""
    rows = requests.where("client is not null and id is not null").where(F.col("ts") <= until)
    each = governance.batches(rows, size, wait_us, "client", "ts", "id").join(rows.select("client", "id", "ts"), ["client", "id"])
    b = each.groupBy("client", "batch").agg(F.min("ts").alias("opened"), F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("place", "id"))).alias("p"))
    by = F.when(F.col("n") == size, "size").when(F.unix_micros(until) - F.unix_micros("opened") >= wait_us, "wait")
    return b.withColumn("closed_by", by).where("closed_by is not null").select("client", "opened", "n", "closed_by", F.col("p.id").alias("ids"))


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, as timers need it; the setting is restored."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def write(closed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed batches to the Parquet files at ``path``, until nothing new is left."""
    with rocks(closed.sparkSession):
        return closed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
