"""Tables that are changed in part: rows stand in buckets by a hash of their key, and a change rewrites only the buckets that its keys fall in.

A bucket is a partition folder.  The buckets that change are first written beside the table
and then moved in by dynamic partition overwriting, which replaces these partitions and no
other.  A change that breaks off while they are moved can lose rows of those buckets; the
copy beside the table still has them, and ``apply`` with it finishes the change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corpusql.errors import VectorStoreError
from corpusql.sources import tables

BUCKET = "bucket"


def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, *key: str, buckets: int = 64) -> None:
    """Write ``df`` as a new table; large buckets are split into several files, small ones aren't."""
    df.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows, without their bucket."""
    return _all(spark, path, schema).drop(BUCKET)


def _all(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType([f for f in s if f.name != BUCKET]).add(BUCKET, "integer")).parquet(path)


def upsert(path: str, schema: StructType | str, new: DataFrame, *key: str, buckets: int = 64, order: str | None = None) -> list[int]:
    """Put the rows of ``new`` in place of those with their keys, or beside them; the buckets that were rewritten.

    ``schema`` is that of the table.  Keys of ``new`` are unique, unless ``order`` names a
    column of it by which the last counts; a key that comes twice without is an error, and
    nothing is changed.  Rows with a null in the key are left out.
    """
    new = new.where(" and ".join(f"{k} is not null" for k in key))
    if order is None:
        twice = tables.duplicates(new, *key).first()
        if twice is not None:
            raise VectorStoreError(f"several rows with the key {tuple(twice)[:-1]}")
    return _change(new.sparkSession, path, schema, lambda old, some: tables.upsert(old, some, *key, order=order), new, key, buckets)


def delete(path: str, schema: StructType | str, keys: DataFrame, *key: str, buckets: int = 64) -> list[int]:
    """Take the rows with ``keys`` out; the buckets that were rewritten."""
    return _change(keys.sparkSession, path, schema, lambda old, some: tables.delete(old, some, *key), keys.select(*key), key, buckets)


def _change(spark: SparkSession, path: str, schema, how, rows: DataFrame, key: tuple[str, ...], buckets: int) -> list[int]:
    at = bucket_of(key, buckets)
    # Numbers of buckets: as many as the table has at most.
    touched = sorted(r[0] for r in rows.select(at).distinct().collect())
    if not touched:
        return []
    old = _all(spark, path, schema).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    staged = f"{path.rstrip('/')}.staged/{uuid.uuid4().hex}"
    how(old, rows).withColumn(BUCKET, at).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(staged)
    try:
        apply(spark, path, schema, staged, touched)
    except Exception as e:
        raise VectorStoreError(f"buckets {touched} of {path} are incomplete; apply() with {staged} finishes the change") from e
    return touched


def apply(spark: SparkSession, path: str, schema, staged: str, touched: list[int]) -> None:
    """Move staged buckets in; doing so again changes nothing."""
    rows = _all(spark, staged, schema)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    # A bucket without a row left is no partition of what was written.
    full = {r[0] for r in rows.select(BUCKET).distinct().collect()}
    for b in sorted(set(touched) - full):
        spark.createDataFrame([], rows.drop(BUCKET).schema).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BUCKET}={b}")
