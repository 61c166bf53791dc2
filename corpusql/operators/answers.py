"""Confidence, context, citations and canned answers for ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusql.functions.text import excerpt


def _confidence_parts() -> list[Column]:
    r, s = F.col("rank"), F.col("score")
    at = lambda i: F.max(F.when(r == i, s))
    top5 = F.when(r <= 5, s)
    return [F.count("*").alias("n_chunks"), at(1).alias("s1"), at(2).alias("s2"), at(3).alias("s3"), F.avg(top5).alias("m"), F.stddev_pop(top5).alias("d")]


def _confidence() -> Column:
    n = F.col("n_chunks")
    best = F.when(n == 1, F.col("s1")).when(n == 2, F.col("s1") * 0.7 + F.col("s2") * 0.3).otherwise(F.col("s1") * 0.5 + F.col("s2") * 0.3 + F.col("s3") * 0.2)
    amount = F.when(n == 1, 0.7).when(n <= 3, 0.85).when(n <= 6, 1.0).otherwise(0.95)
    even = F.when(n == 1, 0.8).otherwise(F.greatest(F.lit(0.5), 1 - F.least(F.lit(1.0), F.when(F.col("m") == 0, 1.0).otherwise(F.col("d") / F.col("m")))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), best * 0.7 + amount * 0.2 + even * 0.1))


def _context() -> Column:
    listed = F.sort_array(F.collect_list(F.struct("rank", "content")))
    return F.array_join(F.transform(listed, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["content"], F.lit("\n\n"))), "")


def confidence(ranked: DataFrame) -> DataFrame:
    """``query_id, n_chunks, confidence`` from ``query_id, rank, score``: 70 % the best three, 20 % their number, 10 % their evenness."""
    return ranked.groupBy("query_id").agg(*_confidence_parts()).select("query_id", "n_chunks", _confidence().alias("confidence"))


def context(ranked: DataFrame) -> DataFrame:
    """``query_id, context``: the chunks by rank, each as ``[i] content`` and a blank line."""
    return ranked.groupBy("query_id").agg(_context().alias("context"))


def summary(ranked: DataFrame) -> DataFrame:
    """Confidence, context and citations of each query in one aggregation."""
    cited = F.sort_array(F.collect_list(F.struct("id", excerpt(F.col("content")).alias("excerpt"))))
    g = ranked.groupBy("query_id").agg(*_confidence_parts(), _context().alias("context"), cited.alias("citations"))
    return g.select("query_id", "n_chunks", _confidence().alias("confidence"), "context", "citations")


def citations(ranked: DataFrame) -> DataFrame:
    """One for each chunk: ``query_id, id, document_id, excerpt, score`` (0 where it has none)."""
    return ranked.select("query_id", "id", "document_id", excerpt(F.col("content")).alias("excerpt"), F.coalesce("score", F.lit(0.0)).alias("score"))


def prompt(query: Column, context_: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context_, F.lit("Question: "), query, F.lit("\nAnswer:"))


def canned_answer(query: Column, n_chunks: Column) -> Column:
    """What is answered without a language model."""
    low = F.lower(query)
    return (
        F.when(n_chunks == 0, "No relevant passage was found.")
        .when(low.contains("what is"), "The passages cited define it.")
        .when(low.contains("how to"), "The passages cited give the steps.")
        .otherwise("See the passages cited.")
    )
