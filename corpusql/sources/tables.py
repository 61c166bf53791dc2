"""Tables on shared storage, and views of the test tables in the engine's shape."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-12-31 00:00:00"
SOURCE_TYPES = ("tutorial", "solution", "reference", "blog")


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def documents(spark: SparkSession, base: str) -> DataFrame:
    """``id, document_id, content, category, tags, metadata, created_at, topic, source_type``: a document is one chunk.

    Its first 60 characters stand for its topic, and its number gives it a type of source
    (every fifth has none).
    """
    d = read(spark, base, "documents")
    created = F.timestamp_add("DAY", F.pmod("doc_id", F.lit(365)).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("document_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("category"),
        F.array("source", "lang").alias("tags"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
        created.alias("created_at"),
        F.substring("text", 1, 60).alias("topic"),
        F.try_element_at(F.array(*[F.lit(x) for x in SOURCE_TYPES]), F.pmod("doc_id", F.lit(5)).cast("int") + 1).alias("source_type"),
    )


def vectors(spark: SparkSession, base: str) -> DataFrame:
    return read(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def queries(spark: SparkSession, base: str) -> DataFrame:
    """``query_id, text, qv``: benchmark texts with the vectors of the same number."""
    b = read(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return b.join(vectors(spark, base).select(F.col("id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")


def upsert(old: DataFrame, new: DataFrame, *key: str, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys.

    With ``order``, a column of ``new`` that is not kept, the last of several rows with one
    key counts; without it keys of ``new`` must be unique.
    """
    if order is not None:
        rest = [c for c in new.columns if c not in (*key, order)]
        new = new.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__l")).select(*key, *[F.col(f"__l.{c}").alias(c) for c in rest])
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def rewrite(df: DataFrame, path: str, *partition: str) -> str:
    """Write a new version in a folder of its own below ``path`` and return it; readers of older ones are not disturbed."""
    at = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition) if partition else df.write).parquet(at)
    return at


def duplicates(table: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
