"""Daily audit reports, kept up to date from a growing table of events.

    python jobs/audit_daily.py --config jobs/audit_daily.toml --source DIR --target DIR

Each run takes the events above the high-water mark (event ids grow as events arrive), adds
them to the audit log as one load, and makes the reports of the days that the load touches
anew, whenever those days were:

    target/audit/day=<date>/load=<n>/*.parquet    the log
    target/daily/day=<date>/*.parquet             the reports
    target/marks/load=<n>/*.parquet               the mark, written last

A run that breaks off before its mark is repeated under the same number.  The source only
grows, so what it then takes holds all that the broken run took, and each partition that one
had written is replaced: dynamic overwriting replaces the partitions that a run writes and no
others.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import tomllib

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

log = logging.getLogger("audit_daily")

MARK = "high long, events long, load int"
AUDIT = "event_id long, ts timestamp, event_type string, user_id string, severity string, success boolean, duration_ms double, data_size long, day date, load int"
DAILY = "kind string, name string, n long, failed long, avg_duration double, bytes long, day date"
DEFAULTS = {"severity": {"error": "High", "signup": "Medium", "purchase": "Critical"}, "failed": ["error"], "top_users": 10}


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the job's own; empty before anything is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def audit_rows(events: DataFrame, severity: dict[str, str], failed: list[str]) -> DataFrame:
    """Events as audit rows with their ``day`` (null without a time)."""
    level = F.lit("Info")
    for kind, name in severity.items():
        level = F.when(F.col("event_type") == kind, name).otherwise(level)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        level.alias("severity"),
        (~F.coalesce(F.col("event_type").isin(failed), F.lit(False))).alias("success"),
        F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").try_cast("long").alias("data_size"),
        F.col("ts").cast("date").alias("day"),
    )


def reports(audit: DataFrame, top_users: int) -> DataFrame:
    """For each day in all, by type, by severity and for the busiest users, in one pass over grouping sets."""
    by = ["day", "event_type", "severity", "user_id"]
    sets = [[F.col(c) for c in x] for x in (by[:1], by[:2], [by[0], by[2]], [by[0], by[3]])]
    a = audit.groupingSets(sets, *by).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration"),
        F.coalesce(F.sum("data_size"), F.lit(0)).alias("bytes"),
    )
    kind = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "event_type").when(F.col("g") == 5, "severity").otherwise("user_id")
    name = F.when(F.col("g") == 7, "").when(F.col("g") == 3, F.col("event_type")).when(F.col("g") == 5, F.col("severity")).otherwise(F.col("user_id"))
    rows = a.select("day", kind.alias("kind"), name.alias("name"), "n", "failed", "avg_duration", "bytes")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "name"))
    users = rows.where("kind = 'user_id'").withColumn("rank", rank).where(F.col("rank") <= top_users).drop("rank")
    return rows.where("kind <> 'user_id'").unionByName(users)


def run(spark: SparkSession, source: str, target: str, **settings) -> int:
    """Take the events that are new; how many these were.

    Events without an id can't be told from those already taken: they are counted in the log
    and left out.  Ids are taken as unique.
    """
    options = DEFAULTS | settings
    done = _table(spark, f"{target}/marks", MARK).agg(F.max("high"), F.max("load")).first()
    high, load = done[0], 0 if done[1] is None else done[1] + 1
    events = spark.read.parquet(source)
    new = events.where("event_id is not null") if high is None else events.where(F.col("event_id") > high)
    top, n = new.agg(F.max("event_id"), F.count("*")).first()
    if not n:
        log.info("read %s: nothing above %s", source, high)
        return 0
    # What arrives from here on belongs to the next load.
    rows = audit_rows(new.where(F.col("event_id") <= top), options["severity"], options["failed"])
    dynamic = {"partitionOverwriteMode": "dynamic"}
    rows.withColumn("load", F.lit(load)).write.mode("overwrite").options(**dynamic).partitionBy("day", "load").parquet(f"{target}/audit")
    audit = _table(spark, f"{target}/audit", AUDIT)
    # A calendar's days: few, and as literals they prune partitions.
    days = [r.day for r in audit.where(F.col("load") == load).select("day").distinct().collect()]
    touched = F.col("day").isin([d for d in days if d is not None])
    if None in days:
        touched = touched | F.col("day").isNull()
    daily = reports(audit.where(touched), options["top_users"])
    # A day's report is a few rows: one file each.
    daily.repartition("day").write.mode("overwrite").options(**dynamic).partitionBy("day").parquet(f"{target}/daily")
    lost = events.where("event_id is null").count()
    spark.createDataFrame([(top, n)], "high long, events long").coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/load={load}")
    log.info("load %d: read %d events of %s up to %s, %d without an id; wrote the reports of %d days to %s/daily", load, n, source, top, lost, len(days), target)
    return n


def daily(spark: SparkSession, target: str) -> DataFrame:
    return _table(spark, f"{target}/daily", DAILY)


def main(args: list[str] | None = None) -> None:
    from corpusql.session import session

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", help="a TOML file; what the command line names comes before it")
    for name in ("source", "target", "master"):
        p.add_argument(f"--{name}")
    given = p.parse_args(args)
    config = {}
    if given.config:
        with open(given.config, "rb") as f:
            config = tomllib.load(f)
    config |= {k: v for k, v in vars(given).items() if v is not None and k != "config"}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("audit_daily", config.pop("master", None))
    try:
        run(spark, config.pop("source"), config.pop("target"), **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
