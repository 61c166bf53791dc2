"""Embedding providers, their limits and fallbacks, and a table of embeddings that are kept.

A provider turns a batch of texts into vectors.  Texts reach it in Arrow batches, cut to the
provider's batch size; where a provider fails, the batch is tried again after a pause and
then goes to the next provider.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusql.errors import EmbeddingError, ValidationError
from corpusql.functions.text import preprocess
from corpusql.operators.vector_search import search


@dataclass(frozen=True)
class Provider:
    """``embed`` gives one row of ``dimension`` numbers for each text of a batch."""

    name: str
    dimension: int
    embed: Callable[[list[str]], np.ndarray]
    max_batch: int = 100
    max_bytes: int = 8192


def ramp(texts: Sequence[str], dimension: int) -> np.ndarray:
    """From the running hash of a text's bytes (31 h + b, 32 bits) a ramp of numbers around 0."""
    out = np.empty((len(texts), dimension))
    for i, t in enumerate(texts):
        h = 0
        for b in t.encode():
            h = (31 * h + b) & 0xFFFFFFFF
        out[i] = ((h + np.arange(dimension)) / 2**32 - 0.5) * 0.2
    return out


def toy(texts: Sequence[str]) -> np.ndarray:
    """A hundredth of the bytes, a ten-thousandth of the sum of code points, and three constants."""
    return np.array([(len(t.encode()) / 100, sum(map(ord, t)) / 10000, 0.5, -0.2, 0.8) for t in texts]).reshape(len(texts), 5)


def local(name: str = "local", dimension: int = 384, max_bytes: int = 512) -> Provider:
    """A stand-in for a model on the worker."""
    return Provider(name, dimension, lambda texts: ramp(texts, dimension), max_bytes=max_bytes)


TOY = Provider("toy", 5, toy, max_bytes=1 << 20)


def limit_issue(text: Column, provider: Provider) -> Column:
    """What keeps a text from the provider, or null."""
    n = F.octet_length(text)
    return F.when(text.isNull(), "null").when(F.trim(text) == "", "empty").when(n > provider.max_bytes, F.format_string(f"%d bytes, at most {provider.max_bytes}", n))


def embed_batch(texts: list[str], providers: Sequence[Provider], retries: int = 3, pause: float = 0.1) -> tuple[np.ndarray, str]:
    """Vectors of a batch and the name of the provider that gave them; each is tried ``retries`` times."""
    last: Exception | None = None
    for p in providers:
        for attempt in range(retries):
            try:
                parts = [np.asarray(p.embed(texts[i : i + p.max_batch]), float) for i in range(0, len(texts), p.max_batch)]
                if any(x.shape != (min(p.max_batch, len(texts) - i * p.max_batch), p.dimension) for i, x in enumerate(parts)):
                    raise EmbeddingError(f"{p.name}: a vector of the wrong size")
                return np.concatenate(parts), p.name
            except Exception as e:  # the next attempt, then the next provider
                last = e
                if attempt + 1 < retries:
                    time.sleep(pause * (attempt + 1))
    raise EmbeddingError("no provider gave vectors") from last


def embedded(df: DataFrame, text_col: str, providers: Sequence[Provider], strict: bool = False, retries: int = 3, pause: float = 0.1) -> DataFrame:
    """``df`` with ``embedding``, ``provider`` and ``embed_issue``.

    A text beyond the first provider's limits has no vector and says why; with ``strict`` it
    is an error.  Columns of ``df`` pass through; only its rows' texts are looked at.
    """
    if not providers or len({p.dimension for p in providers}) > 1:
        raise ValidationError("providers", "one or more, of one dimension")
    rows = df.drop("embedding", "provider", "embed_issue").withColumn("embed_issue", limit_issue(F.col(text_col), providers[0]))
    if strict:
        rows = rows.withColumn("embed_issue", F.when(F.col("embed_issue").isNotNull(), F.raise_error(F.concat(F.lit("embedding input: "), F.col("embed_issue")))))
    at = rows.columns.index(text_col)
    bad = rows.columns.index("embed_issue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.flatnonzero(~np.asarray(b.column(bad).is_valid()))
            vectors: list = [None] * b.num_rows
            names: list = [None] * b.num_rows
            if len(good):
                x, name = embed_batch(b.column(at).take(pa.array(good)).to_pylist(), providers, retries, pause)
                for i, v in zip(good.tolist(), x):
                    vectors[i], names[i] = v, name
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(names, pa.string())], names=[*b.schema.names, "embedding", "provider"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", embedding array<double>, provider string"
    return rows.mapInArrow(run, schema)


def provider_stats(df: DataFrame) -> DataFrame:
    """Texts, vectors, bytes and numbers in a vector, by provider."""
    return df.groupBy("provider").agg(F.count("*").alias("texts"), F.count("embedding").alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dimension"))


def search_text(queries: DataFrame, chunks: DataFrame, providers: Sequence[Provider], k: int = 10, **options) -> DataFrame:
    """``query_id, id, score, rank`` for ``queries`` (query_id, text) among ``chunks`` (id, content).

    Query texts are cleaned as queries are; chunks that have no ``embedding`` column yet are
    embedded by the same providers.
    """
    q = embedded(queries.select("query_id", preprocess(F.col("text")).alias("text")), "text", providers).select("query_id", F.col("embedding").alias("qv"))
    if "embedding" not in chunks.columns:
        chunks = embedded(chunks.select("id", "content"), "content", providers)
    return search(q, chunks.select("id", "embedding"), k, **options)


# Kept embeddings: ``key, embedding, size_bytes, created_at, last_accessed, access_count, expires_at``.


def cache_key(model: str, version: str, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(model), F.lit(version), text), 256)


def entry_bytes(embedding: Column) -> Column:
    return (4 * F.size(embedding) + 64).cast("long")


def is_expired(as_of: Column) -> Column:
    return F.coalesce(as_of > F.col("expires_at"), F.lit(False))


def get_or_compute(df: DataFrame, cache: DataFrame, text_col: str, providers: Sequence[Provider], as_of: Column, *, model: str, version: str = "1", ttl_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``key, embedding`` and ``status`` (hit, expired or miss), and the cache as it is afterwards.

    Each missing text is embedded once however often it occurs.  Entries that were used have
    one access more for each row, and the time of it.
    """
    asked = df.withColumn("key", cache_key(model, version, F.col(text_col)))
    state = cache.select("key", is_expired(as_of).alias("over"))
    asked = asked.join(state, "key", "left").withColumn("status", F.when(F.col("over").isNull(), "miss").when(F.col("over"), "expired").otherwise("hit")).drop("over")
    lacking = asked.where("status <> 'hit'").groupBy("key").agg(F.min(text_col).alias("text"), F.count("*").alias("n"))
    fresh = embedded(lacking, "text", providers)
    fresh = fresh.select(
        "key", "embedding", entry_bytes(F.col("embedding")).alias("size_bytes"), as_of.alias("created_at"), as_of.alias("last_accessed"), F.col("n").alias("access_count"), (as_of + F.make_dt_interval(F.lit(ttl_days))).alias("expires_at")
    )
    used = asked.where("status = 'hit'").groupBy("key").agg(F.count("*").alias("n"))
    kept = cache.join(fresh.select("key"), "key", "left_anti").join(used, "key", "left")
    kept = kept.select(
        "key", "embedding", "size_bytes", "created_at", F.when(F.col("n").isNotNull(), as_of).otherwise(F.col("last_accessed")).alias("last_accessed"), (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"), "expires_at"
    )
    after = kept.unionByName(fresh)
    return asked.join(after.select("key", "embedding"), "key"), after


def maintained(cache: DataFrame, as_of: Column, most: int) -> DataFrame:
    """Without entries that are over, and of the rest the ``most`` most used (then the smallest keys)."""
    return cache.where(~is_expired(as_of)).orderBy(F.desc("access_count"), "key").limit(most)
