"""Keyword scores by BM25 and their blend with vector scores.

The corpus of the statistics is each query's candidate set, as named by ``scope``, or all
chunks.  Only terms that some query asks for leave the chunks: the query terms are few and
are joined before anything is counted across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusql.functions import lexicon
from corpusql.functions.text import terms


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """``query_id, term, qtf`` without stop words."""
    exploded = queries.select("query_id", F.explode(terms(F.col(text), lexicon.STOP_WORDS)).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def chunk_terms(chunks: DataFrame, key: list[str]) -> DataFrame:
    """``key, term, tf`` of chunks with ``content``."""
    return chunks.select(*key, F.explode(terms(F.col("content"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame, *scope: str, average: str = "distinct") -> DataFrame:
    """``n`` and ``avgdl`` of each ``scope``: the mean of distinct (or total) terms a chunk."""
    t = terms(F.col("content"))
    size = F.size(F.array_distinct(t)) if average == "distinct" else F.size(t)
    return chunks.groupBy(*scope).agg(F.count("*").alias("n"), F.avg(size).alias("avgdl"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """``term, df`` over all chunks."""
    return chunks.select(F.explode(F.array_distinct(terms(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column, plus_one: bool = False) -> Column:
    """``ln((n - df + 0.5) / (df + 0.5))``, which is negative for terms in over half of the chunks."""
    x = (n - df + 0.5) / (df + 0.5)
    return F.ln(x + 1 if plus_one else x)


def bm25(queries: DataFrame, candidates: DataFrame, k1: float = 1.2, b: float = 0.75, min_tf: int = 1, plus_one: bool = False, average: str = "distinct") -> DataFrame:
    """``candidates`` (``query_id, id, content`` and more; a pair once) with ``bm25``; 0 without a common term.

    Candidates are dealt by query once; statistics of a query's set are windows over it.
    """
    rest = [c for c in candidates.columns if c not in ("query_id", "id", "bm25")]
    mine = query_terms(queries).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "qtf"))).alias("q"))
    c = candidates.select("query_id", "id", F.struct(*rest).alias("row"), terms(F.col("content")).alias("t")).join(mine, "query_id", "left")
    size = F.size(F.array_distinct("t")) if average == "distinct" else F.size("t")
    matched = F.when(F.col("q").isNull(), F.array().cast("array<string>")).otherwise(F.filter("t", lambda x: F.map_contains_key("q", x)))
    c = c.select("query_id", "id", "row", "q", F.size("t").alias("dl"), size.alias("dt"), matched.alias("m"))
    own = Window.partitionBy("query_id")
    c = c.withColumns({"n": F.count("*").over(own), "avgdl": F.avg("dt").over(own)})
    hits = F.transform(F.array_distinct("m"), lambda t: F.struct(t.alias("term"), F.size(F.filter("m", lambda x: x == t)).alias("tf"), F.element_at("q", t).alias("qtf")))
    c = c.select("query_id", "id", "row", "dl", "n", "avgdl", F.explode_outer(hits).alias("h"))
    c = c.withColumn("df", F.count("h").over(Window.partitionBy("query_id", "h.term")))
    tf = F.col("h.tf")
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    score = F.when(tf >= min_tf, idf(F.col("n"), F.col("df"), plus_one) * weight * F.col("h.qtf"))
    out = c.groupBy("query_id", "id").agg(F.first("row").alias("row"), F.coalesce(F.sum(score), F.lit(0.0)).alias("bm25"))
    return out.select("query_id", "id", *[F.col("row").getField(x).alias(x) for x in rest], "bm25")


def blend(vector: Column, keyword: Column, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> Column:
    return vector_weight * vector + keyword_weight * F.tanh(keyword / 10)


def legacy_keyword(query: Column, content: Column) -> Column:
    """Mean frequency of the query's terms times one plus their coverage, 1 at most."""
    q = terms(query, lexicon.STOP_WORDS)
    w = F.filter(F.split(F.lower(content), r"\s+"), lambda x: x != "")
    n = F.size(w)
    counts = F.transform(q, lambda t: F.size(F.filter(w, lambda x: x == t)))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    matched = F.size(F.filter(counts, lambda x: x > 0))
    return F.when((n == 0) | (F.size(q) == 0), 0.0).otherwise(F.least(F.lit(1.0), total / n / F.size(q) * (1 + matched / F.size(q))))
