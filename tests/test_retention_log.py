"""The replay of a log of actions against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusql.operators import retention_log as rl

ACTIONS = ["hold", "release", "request", "approve", "delete", "delete", "approve"]
SCHEMA = "data_id long, id long, ts timestamp, action string"


def plain(records, actions):
    state = {r[0]: [r[1] or "Active", r[2] or 0, r[3]] for r in records}
    out = []
    for key, i, ts, action in sorted((a for a in actions if a[2] is not None), key=lambda a: (a[2], a[1])):
        if key not in state or action not in ACTIONS:
            out.append((key, i, None, None, True))
            continue
        status, holds, until = state[key]
        held, no = holds > 0, False
        if action == "hold":
            status, holds = "LegalHold", holds + 1
        elif action == "release":
            holds = max(0, holds - 1)
            if not holds:
                status = "Expired" if until is not None and ts > until else "Active"
        elif action == "request":
            no = held
            status = status if held else "DeletionRequested"
        elif action == "approve":
            no = status != "DeletionRequested"
            status = status if no else "DeletionApproved"
        else:
            no = held or status not in ("DeletionApproved", "Expired")
            status = status if no else "SoftDeleted"
        state[key] = [status, holds, until]
        out.append((key, i, status, holds, no))
    return out, state


def day(n, seconds=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, seconds=seconds)


@pytest.mark.parametrize("every", [1, 7, 400])
def test_replay(spark, every):
    rng = random.Random(every)
    starts = ["Active", "Expired", "DeletionRequested", "DeletionApproved", "LegalHold", "SoftDeleted", None]
    records = [(k, starts[k % 7], k % 3 or None, day(30) if k % 4 else None) for k in range(60)]
    actions = [(rng.randrange(60), i, day(rng.randrange(90), rng.randrange(3) * 40_000), rng.choice(ACTIONS)) for i in range(1500)]
    # One record has most of the log, many of its actions at one time.
    actions += [(7, 2000 + i, day(rng.randrange(90)), rng.choice(ACTIONS)) for i in range(1500)]
    table = spark.createDataFrame(actions, SCHEMA).repartition(7)
    recs = spark.createDataFrame(records, "data_id long, status string, holds int, expires_at timestamp")
    out = rl.replay(recs, table, every)
    want, state = plain(records, actions)
    got = sorted((r.data_id, r.id, r.status, r.holds, r.rejected) for r in out.collect())
    assert got == sorted(want)
    assert {r.data_id: (r.status or "Active", r.holds or 0) for r in rl.final(out, recs).collect()} == {k: tuple(v[:2]) for k, v in state.items()}


def test_odd_logs(spark):
    recs = spark.createDataFrame([(1, "Active", 0, day(0)), (2, None, None, None)], "data_id long, status string, holds int, expires_at timestamp")
    rows = [(1, 1, None, "hold"), (1, 2, day(1), None), (1, 3, day(2), "shred"), (None, 4, day(2), "hold"), (9, 5, day(2), "hold"), (2, 6, day(3), "release")]
    out = {r.id: r for r in rl.replay(recs, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, r in out.items() if r.rejected} == {1, 2, 3, 4, 5} and out[9 - 4].status is None and out[1].status == "Active"
    assert (out[6].status, out[6].holds, out[6].rejected) == ("Active", 0, False)
    assert rl.replay(recs, spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.data_id: r.status for r in rl.final(rl.replay(recs, spark.createDataFrame([], SCHEMA)), recs).collect()} == {1: "Active", 2: None}


def test_a_hot_record_is_cut(spark):
    """The windows over rows are of a record and a span of time, never of a record alone."""
    recs = spark.createDataFrame([(1, "Active", 0, day(0))], "data_id long, status string, holds int, expires_at timestamp")
    log = spark.range(1000).select(F.lit(1).alias("data_id"), "id", (F.lit(day(0)).cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"), F.lit("hold").alias("action"))
    out = rl.replay(recs, log, 10)
    assert out.where("holds = id + 1").count() == 1000
    a = log.withColumn("span", F.floor(F.unix_seconds("ts") / (86_400 * 10)))
    assert a.groupBy("span").count().agg(F.max("count")).first()[0] == 10
