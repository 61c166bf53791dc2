"""From documents to validated, sanitised, chunked and embedded rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusql.functions import text as T
from corpusql.functions import validation as V
from corpusql.functions.vectors import mock_embedding
from corpusql.operators.chunking import chunks


def validated(docs: DataFrame, text: str = "text", file_type: Column | None = None) -> DataFrame:
    """``docs`` with a struct ``validation``."""
    return docs.withColumn("validation", V.validate(F.col(text), file_type))


def ingest(docs: DataFrame, id_col: str = "doc_id", strategy: str = "fixed", embed: Callable[[Column], Column] = mock_embedding, **options) -> DataFrame:
    """Chunks of valid documents: ``document_id, chunk_index, content, embedding, language, word_count``.

    Narrow from end to end: no shuffle between the scan and the write.
    """
    # What is valid is told once, by the filter.
    good = docs.where(F.size(V.errors(F.col("text"))) == 0).select(F.col(id_col), V.sanitise(F.col("text")).alias("text"))
    # Counts before the language that they tell, so that they are made once.
    out = chunks(good, strategy, id_col, "text", **options).select("*", T.language_counts(F.col("content")).alias("counts"))
    return out.select("document_id", "chunk_index", "content", embed(F.col("content")).alias("embedding"), T.language_of(F.col("counts")).alias("language"), T.word_count(F.col("content")).alias("word_count"))


def batch_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Totals of a batch: valid and invalid documents, warnings, errors, bytes, mean quality."""
    v = validated(docs, text)
    return v.agg(
        F.count("*").alias("total"),
        F.count_if("validation.valid").alias("valid"),
        F.count_if(~F.col("validation.valid")).alias("invalid"),
        F.sum(F.size("validation.warnings")).alias("warnings"),
        F.sum(F.size("validation.errors")).alias("errors"),
        F.sum(F.octet_length(text)).alias("bytes"),
        F.round(F.avg("validation.quality"), 6).alias("avg_quality"),
    )


def batch_jobs(docs: DataFrame, batch: str, text: str = "text") -> DataFrame:
    """A job record for each batch: its files, those done and those that failed; one bad file stops no other."""
    ok = V.quick_valid(F.col(text))
    return docs.groupBy(batch).agg(F.count("*").alias("files"), F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"))


def progress(chunks_: DataFrame) -> DataFrame:
    return chunks_.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
