"""A near table of few, young entries before a far table of all: look-ups, writes, clearing.

Tables have ``key, value, size_bytes, created_at, expires_at``; the near one is meant to be
persisted by the session, the far one is Parquet, whose codec stands for compression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NEAR_SECONDS = 300


def live(entries: DataFrame, as_of: Column) -> DataFrame:
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def look_up(wanted: DataFrame, near: DataFrame, far: DataFrame, as_of: Column) -> DataFrame:
    """``wanted`` with ``value`` and the ``level`` that had it (near, far, or null for neither)."""
    n = live(near, as_of).select("key", F.col("value").alias("__n"))
    f = live(far, as_of).join(n, "key", "left_anti").select("key", F.col("value").alias("__f"))
    out = wanted.join(n, "key", "left").join(f, "key", "left")
    level = F.when(F.col("__n").isNotNull(), "near").when(F.col("__f").isNotNull(), "far")
    return out.withColumn("value", F.coalesce("__n", "__f")).withColumn("level", level).drop("__n", "__f")


def promoted(found: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Entries for the near table from what the far one had; they live ``ttl_seconds``, five minutes at most."""
    rows = found.where("level = 'far'").groupBy("key").agg(F.first("value").alias("value"))
    return rows.select("key", "value", F.octet_length(F.col("value").cast("string")).cast("long").alias("size_bytes"), as_of.alias("created_at"), (as_of + F.make_dt_interval(secs=F.lit(min(ttl_seconds, NEAR_SECONDS)))).alias("expires_at"))


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``entries`` with the ``new`` ones in place of those with their keys."""
    return entries.join(new.select("key"), "key", "left_anti").unionByName(new)


def drop(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key").distinct(), "key", "left_anti")

