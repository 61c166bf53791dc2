"""What a log of actions makes of retention records: every action in order, the status it leads to, and whether it was turned away.

Actions on a record are a hold, a release of one hold, a request to delete, an approval and a
deletion.  A record's log is cut by time, so that one record with a great part of all
actions is read by many tasks.  Two things pass from one span of time to the next:

* the number of holds.  A release without a hold changes nothing, so the number is the
  running sum of +1 and -1 less the least that this sum has been below zero; sums and least
  sums of the spans are enough to carry it on;
* the status.  A hold, a last release and an allowed request each set it whatever it was;
  what can follow in between, an approval and a deletion, depends only on how many of them
  came since.  So a span is told by the last status that it set and those counts, and the
  spans of a record (a row each) are folded in order.

Within a span everything is a window over its rows; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START = "data_id", "status", "holds", "expires_at"


def after(base: Column, approvals: Column, approved_deletes: Column, deletes: Column) -> Column:
    """The status that was ``base`` when it was last set, after some approvals and allowed deletions (of these, some after an approval)."""
    gone = F.lit("SoftDeleted")
    return (
        F.when((base == "DeletionRequested") & (approved_deletes > 0), gone)
        .when((base == "DeletionRequested") & (approvals > 0), "DeletionApproved")
        .when(base.isin("DeletionApproved", "Expired") & (deletes > 0), gone)
        .otherwise(base)
    )


def replay(records: DataFrame, actions: DataFrame, every_days: int = 30) -> DataFrame:
    """``data_id, id, ts, action, status, holds, rejected``: each action, what holds after it, and whether it was turned away.

    ``records``: ``data_id, status, holds`` (a number), ``expires_at``, the state before the
    log; ``actions``: ``data_id, id, ts, action``.  Actions of one time are taken by ``id``.
    An action on no record, an unknown one and one without a time are turned away (status
    null for the first).  ``every_days`` changes the cost and not the result.
    """
    order = ["ts", "id"]
    known = records.select("data_id", F.coalesce("status", F.lit("Active")).alias("was"), F.coalesce("holds", F.lit(0)).cast("long").alias("h0"), "expires_at", F.lit(True).alias("known"))
    a = actions.select("data_id", "id", F.col("ts").cast("timestamp").alias("ts"), "action").join(known, "data_id", "left")
    valid = F.coalesce("known", F.lit(False)) & F.col("ts").isNotNull() & F.col("action").isin("hold", "release", "request", "approve", "delete")
    valid = F.coalesce(valid, F.lit(False))
    lost = a.where(~valid).select("data_id", "id", "ts", "action", F.col("was").alias("status"), F.col("h0").alias("holds"), F.lit(True).alias("rejected"))
    day = 86_400 * every_days
    a = a.where(valid).withColumn("span", F.floor(F.unix_seconds("ts") / day)).withColumn("d", F.when(F.col("action") == "hold", 1).when(F.col("action") == "release", -1).otherwise(0))

    own = Window.partitionBy("data_id", "span").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("data_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)

    # Holds: the sum of a span, the least sum within it, and what both are before each span.
    a = a.withColumn("s", F.sum("d").over(so_far)).withColumn("m", F.min("s").over(so_far))
    spans = a.groupBy("data_id", "span").agg(F.first("h0").alias("first"), F.sum("d").alias("total"), F.min("s").alias("low"))
    spans = spans.withColumn("s0", F.col("first") + F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    spans = spans.withColumn("m0", F.least(F.lit(0), F.min(F.col("s0") + F.col("low")).over(earlier))).select("data_id", "span", "s0", "m0")
    a = a.join(spans, ["data_id", "span"])
    a = a.withColumn("c", F.col("s0") + F.col("s") - F.least(F.col("m0"), F.col("s0") + F.col("m")))
    a = a.withColumn("before", F.lag("c").over(own)).withColumn("before", F.coalesce("before", F.col("s0") - F.col("m0")))

    # Status: what an action sets it to, whatever it was; and what came since it was last set.
    free = F.col("before") == 0
    sets = F.when(F.col("action") == "hold", "LegalHold").when((F.col("action") == "release") & (F.col("c") == 0), F.when(F.col("ts") > F.col("expires_at"), "Expired").otherwise("Active")).when((F.col("action") == "request") & free, "DeletionRequested")
    a = a.withColumns({"sets": sets, "approve": (F.col("action") == "approve").cast("int"), "delete": ((F.col("action") == "delete") & free).cast("int")})
    a = a.withColumns({"base": F.last("sets", ignorenulls=True).over(so_far), "part": F.count("sets").over(so_far)})
    since = Window.partitionBy("data_id", "span", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = a.withColumns({"approvals": F.sum("approve").over(since), "deletes": F.sum("delete").over(since)})
    a = a.withColumn("approved_deletes", F.sum(F.when(F.col("approvals") > 0, F.col("delete")).otherwise(0)).over(since))

    last = a.groupBy("data_id", "span").agg(F.first("was").alias("was"), F.max_by(F.struct("base", "approvals", "approved_deletes", "deletes"), F.struct(*order)).alias("e"))
    listed = last.groupBy("data_id").agg(F.first("was").alias("was"), F.sort_array(F.collect_list(F.struct("span", "e"))).alias("es"))
    step = lambda at, e: F.struct(
        F.concat(at["out"], F.array(F.struct(e["span"].alias("span"), at["now"].alias("status")))).alias("out"),
        after(F.coalesce(e["e"]["base"], at["now"]), e["e"]["approvals"], e["e"]["approved_deletes"], e["e"]["deletes"]).alias("now"),
    )
    none = F.array().cast("array<struct<span:bigint,status:string>>")
    folded = listed.select("data_id", F.explode(F.aggregate("es", F.struct(none.alias("out"), F.col("was").alias("now")), step, lambda at: at["out"])).alias("o")).select("data_id", F.col("o.span").alias("span"), F.col("o.status").alias("at"))

    a = a.join(folded, ["data_id", "span"]).withColumn("base", F.coalesce("base", "at"))
    status = after(F.col("base"), F.col("approvals"), F.col("approved_deletes"), F.col("deletes"))
    # The first approval, and the first deletion that is allowed, change something; later ones don't.
    approved = (F.col("base") == "DeletionRequested") & (F.col("approvals") == 1)
    deleted = (F.col("delete") == 1) & F.when(F.col("base") == "DeletionRequested", F.col("approved_deletes") == 1).otherwise(F.col("base").isin("DeletionApproved", "Expired") & (F.col("deletes") == 1))
    deleted = deleted & ~((F.col("base") == "DeletionRequested") & (F.col("approvals") == 0))
    rejected = F.when(F.col("action") == "request", ~free).when(F.col("action") == "approve", ~approved).when(F.col("action") == "delete", ~deleted).otherwise(F.lit(False))
    out = a.select("data_id", "id", "ts", "action", status.alias("status"), F.col("c").alias("holds"), rejected.alias("rejected"))
    return out.unionByName(lost)


def final(replayed: DataFrame, records: DataFrame) -> DataFrame:
    """``data_id, status, holds`` of every record after the log."""
    last = replayed.where("status is not null and ts is not null").groupBy("data_id").agg(F.max_by(F.struct("status", "holds"), F.struct("ts", "id")).alias("l"))
    r = records.select("data_id", "status", F.col("holds").cast("long").alias("holds")).join(last, "data_id", "left")
    return r.select("data_id", F.coalesce("l.status", "status").alias("status"), F.coalesce("l.holds", "holds").alias("holds"))
