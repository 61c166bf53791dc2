"""From a batch of queries to ranked passages, contexts and confidences, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusql.functions import query_text as Q
from corpusql.functions import relevance as R
from corpusql.functions.lexicon import PRESETS
from corpusql.functions.text import words
from corpusql.operators import answers, bm25
from corpusql.operators.governance import running_average
from corpusql.operators.ranking import top
from corpusql.operators.vector_search import search


@dataclass(frozen=True)
class Options:
    """``filter_mode``: filters before the vector search (``pre``) or among its results (``post``)."""

    chunks: int = 10
    candidates: int = 20
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    threshold: float | None = None
    filter_mode: str = "pre"
    least_relevance: float = 0.3

    def __post_init__(self) -> None:
        if not 1 <= self.chunks <= 50 or self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("chunks from 1 to 50, threshold from 0 to 1")


def candidates(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, options: Options = Options(), where: Column | None = None) -> DataFrame:
    """``query_id, id, vector_score, rank`` with the columns of ``chunks``: the best by vector, filtered."""
    searched = vectors
    if where is not None and options.filter_mode == "pre":
        searched = vectors.join(chunks.where(where).select("id"), "id", "left_semi")
    found = search(queries, searched, options.candidates, threshold=options.threshold).withColumnRenamed("score", "vector_score")
    out = found.join(chunks, "id")
    return out.where(where) if where is not None and options.filter_mode == "post" else out


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, options: Options = Options(), where: Column | None = None) -> DataFrame:
    """``query_id, id, document_id, content, created_at, vector_score, bm25, score, rank``."""
    scored = bm25.bm25(queries, candidates(queries, chunks, vectors, options, where).drop("rank")).withColumn("score", F.round(bm25.blend(F.col("vector_score"), F.col("bm25"), options.vector_weight, options.keyword_weight), 9))
    return top(scored, options.chunks, "score", "id", "query_id")


def relevance(queries: DataFrame, ranked: DataFrame, as_of: Column, preset: str = "general", authority: DataFrame | None = None) -> DataFrame:
    """``ranked`` with its five scores, boost, overall relevance and confidence.

    ``topic`` and ``source_type`` of the chunk count where it has them; ``authority``
    (``document_id, authority``) holds what a document's source is worth, 0.5 where it
    doesn't name it.
    """
    for c in ("topic", "source_type"):
        if c not in ranked.columns:
            ranked = ranked.withColumn(c, F.lit(None).cast("string"))
    worth = F.lit(0.5)
    if authority is not None:
        ranked = ranked.join(authority.select("document_id", "authority"), "document_id", "left")
        worth = F.coalesce("authority", F.lit(0.5))
    r = ranked.join(queries.select("query_id", Q.analysis(F.col("text")).alias("analysis")), "query_id")
    # Words and lower-case text are made once a row and used by all scores.
    r = r.withColumns({"__w": words(F.col("content")), "__low": F.lower("content")})
    a, content = F.col("analysis"), R.Content(F.col("content"), F.col("__w"), F.col("__low"))
    r = r.withColumns(
        {
            "semantic": R.semantic(F.col("vector_score"), a),
            "keyword": R.keyword(F.tanh(F.col("bm25") / 10), a, content),
            "quality": R.document_quality(content, worth),
            "freshness": R.freshness(F.col("created_at"), as_of, a),
            "context": R.context(a, F.col("topic"), F.col("source_type")),
            "boost": R.boost(a, content),
        }
    ).drop("__w", "__low")
    five = [F.col(c) for c in ("semantic", "keyword", "quality", "freshness", "context")]
    return r.withColumn("overall", R.overall(*five, F.col("boost"), PRESETS[preset])).withColumn("confidence", R.confidence(*five))


def enhanced(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, as_of: Column, options: Options = Options(candidates=50), preset: str = "general") -> DataFrame:
    """Two stages: many candidates by vector and keyword, then the most relevant of them."""
    r = relevance(queries, bm25.bm25(queries, candidates(queries, chunks, vectors, options).drop("rank")), as_of, preset)
    r = r.withColumn("score", F.round("overall", 9)).where(F.col("score") >= options.least_relevance)
    return top(r, options.chunks, "score", "id", "query_id")


def answer(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, options: Options = Options()) -> DataFrame:
    """One row a query: ``query_id, n_chunks, confidence, context, answer, citations``."""
    ranked = hybrid(queries, chunks, vectors, options)
    # A query's rows meet once, so the search runs once.
    out = queries.select("query_id", "text").join(answers.summary(ranked), "query_id", "left")
    n = F.coalesce("n_chunks", F.lit(0).cast("long"))
    return out.select("query_id", n.alias("n_chunks"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "context", answers.canned_answer(F.col("text"), n).alias("answer"), "citations")


def running_latency(log: DataFrame) -> DataFrame:
    """Mean duration of each query type so far, in order of time."""
    return running_average(log, "value", ["event_type"], ["ts", "event_id"]).withColumnRenamed("running_avg", "mean_so_far")
