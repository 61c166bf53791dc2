"""The batcher as a stream, over files that come one by one, against the same on a table."""

import datetime as dt

from conftest import DATA
from pyspark.sql import functions as F

from corpusql.streaming import batcher

REQUESTS = "client long, id long, ts timestamp"
WAIT = 3 * 3_600_000_000


def run(spark, src, out):
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(src)
    batcher.write(batcher.batches(stream, 3, WAIT), f"{out}/closed", f"{out}/state").awaitTermination()
    return spark.read.schema(batcher.CLOSED).parquet(f"{out}/closed")


def rows(df):
    return sorted((r.client, r.opened, r.n, r.closed_by, list(r.ids)) for r in df.collect())


def test_stream_is_table(spark, tmp_path):
    """Growing input, restarts, requests out of order within the time that lateness allows, and what comes too late."""
    before = spark.conf.get(batcher.STORE, None)
    r = spark.read.parquet(f"{DATA}/events.parquet").select((F.col("user_id") % 5).alias("client"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = ["2024-01-01", "2024-01-08", "2024-01-20", "2024-02-28"]
    for since, until in zip(cuts, cuts[1:]):
        part = r.where((F.col("ts") >= since) & (F.col("ts") < until))
        # The last ten minutes' worth of rows of a part may stand before others: order in a file is free.
        part.orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(src)
        closed = run(spark, src, out)
        last = part.agg(F.max("ts")).first()[0]
        want = batcher.closed_batches(r.where(F.col("ts") < until), F.lit(last.replace(microsecond=last.microsecond // 1000 * 1000) - dt.timedelta(minutes=10)), 3, WAIT)
        assert rows(closed) == rows(want)
    n = closed.count()
    assert rows(run(spark, src, out)) == rows(closed)  # nothing new
    late = spark.createDataFrame([(1, 10**6, dt.datetime(2024, 1, 2)), (None, 10**6 + 1, dt.datetime(2024, 3, 1)), (2, None, dt.datetime(2024, 3, 1)), (3, 10**6 + 2, None)], REQUESTS)
    late.coalesce(1).write.mode("append").parquet(src)
    again = run(spark, src, out)
    assert again.where(F.exists("ids", lambda i: i >= 10**6)).count() == 0 and again.count() == n
    assert spark.conf.get(batcher.STORE, None) == before and {r.closed_by for r in closed.collect()} == {"size", "wait"}


def test_ties_and_limits(spark):
    """Requests of one moment count by their ids; a batch of one; a wait that ends at the very moment."""
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    r = spark.createDataFrame([(1, 2, t(0)), (1, 1, t(0)), (1, 3, t(0)), (1, 4, t(0)), (2, 5, t(0)), (2, 6, t(60)), (3, 7, t(100))], REQUESTS)
    got = rows(batcher.closed_batches(r, F.lit(t(120)), 3, 60_000_000))
    assert got == [(1, t(0), 1, "wait", [4]), (1, t(0), 3, "size", [1, 2, 3]), (2, t(0), 1, "wait", [5]), (2, t(60), 1, "wait", [6])]
    assert batcher.closed_batches(r.limit(0), F.lit(t(0))).count() == 0
