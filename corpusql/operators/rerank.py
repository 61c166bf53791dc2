"""Reordering of a query's ranked chunks.

Input rows have ``query_id, id, document_id, content, created_at, score, rank``; all work is
within a query's few ranked rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusql.functions import lexicon
from corpusql.functions import relevance as R
from corpusql.functions.text import jaccard, words
from corpusql.functions.vectors import cosine
from corpusql.operators.ranking import cap


def _ranked(df: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("final_score", 9)), "id")
    return df.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= most)


def original(df: DataFrame, most: int = 10) -> DataFrame:
    return df.where(F.col("rank") <= most).withColumn("final_score", F.col("score")).withColumn("new_rank", F.col("rank"))


def quality(df: DataFrame, most: int = 10, weight: float = 0.15, up: float = 1.2, down: float = 0.8) -> DataFrame:
    q = R.rerank_quality(F.col("content"))
    q9 = F.round("quality", 9)  # a sum of tenths, which may land on the limit
    factor = F.when(q9 > 0.7, up).when(q9 < 0.3, down).otherwise(1.0)
    return _ranked(df.withColumn("quality", q).withColumn("final_score", F.col("score") * factor + weight * F.col("quality")), most)


def temporal(df: DataFrame, as_of: Column, most: int = 10, weight: float = 0.1) -> DataFrame:
    r = R.recency(F.col("created_at"), as_of)
    return _ranked(df.withColumn("recency", r).withColumn("final_score", F.col("score") + weight * F.col("recency")), most)


def _with_likeness(df: DataFrame, of: Column, likeness: Callable[[Column, Column], Column], pick: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``likeness``: the least or largest of ``of`` with the rows before in the query; null for the first.

    A query's ranked rows are few; they meet once in an array, so what made them runs once.
    """
    rows = F.struct("rank", of.alias("of"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    listed = df.groupBy("query_id").agg(F.sort_array(F.collect_list(rows)).alias("rs")).select("rs", F.transform("rs", lambda r: r["of"]).alias("all"))
    scored = F.transform("rs", lambda r, i: F.struct(r["row"].alias("row"), pick(F.transform(F.slice("all", 1, i), lambda y: likeness(r["of"], y))).alias("likeness")))
    return listed.select(F.explode(scored).alias("r")).select("r.row.*", "r.likeness")


def _diverse(df: DataFrame, least: bool = True, threshold: float = 0.85, penalty: float = 0.5) -> DataFrame:
    """``diversity``: 1 less the least (or largest) likeness with the rows before; 1 for the first."""
    out = _with_likeness(df, F.array_distinct(words(F.col("content"))), jaccard, F.array_min if least else F.array_max)
    d = F.when(F.col("likeness").isNull(), 1.0).otherwise((1 - F.col("likeness")) * F.when(F.col("likeness") > threshold, 1 - penalty).otherwise(1.0))
    return out.withColumn("diversity", d).drop("likeness")


def diversity(df: DataFrame, most: int = 10, per_document: int = 3, weight: float = 0.2, least: bool = True) -> DataFrame:
    """The first ``most`` rows with at most ``per_document`` of a document, by score and diversity."""
    kept = cap(df, per_document, [F.col("rank")], "query_id", "document_id")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= most)
    return _ranked(_diverse(kept, least).withColumn("final_score", F.col("score") + weight * F.col("diversity")), most)


def adaptive_weights(a: Column) -> Column:
    """Struct of quality, diversity and recency weights for an analysis."""
    base = [F.lit(x) for x in (0.2, 0.2, 0.15)]
    for kind, w in lexicon.ADAPTIVE.items():
        base = [F.when(a["type"] == kind, x).otherwise(y) for x, y in zip(w, base)]
    q, d, r = (F.when(a["temporal"], x + y).otherwise(x) for x, y in zip(base, (-0.1, -0.1, 0.2)))
    total = F.greatest(F.lit(1.0), q + d + r)
    return F.struct((q / total).alias("quality"), (d / total).alias("diversity"), (r / total).alias("recency"))


def hybrid(df: DataFrame, as_of: Column, most: int = 10, candidates: int = 50, per_document: int = 3, original_weight: float = 0.3) -> DataFrame:
    """By score, quality, recency and diversity; rows carry the query's ``analysis``."""
    kept = cap(df, per_document, [F.col("rank")], "query_id", "document_id")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= candidates)
    d = _diverse(kept).withColumn("w", adaptive_weights(F.col("analysis")))
    final = original_weight * F.col("score") + F.col("w.quality") * R.rerank_quality(F.col("content")) + F.col("w.recency") * R.recency(F.col("created_at"), as_of) + F.col("w.diversity") * F.col("diversity")
    return _ranked(d.withColumn("final_score", final), most).drop("w")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"Original": original, "Quality": quality, "Temporal": temporal, "Diversity": diversity, "Hybrid": hybrid}


def rerank(df: DataFrame, strategy: str, **options) -> DataFrame:
    """One of ``STRATEGIES`` by name."""
    return STRATEGIES[strategy](df, **options)


def mmr(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over each query's rows (``embedding`` too): ``query_id, id, new_rank``.

    Greedy and so sequential: a grouped function over the few rows of a query.  The first row
    stays first; of equals the one that was ahead wins.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"]).reset_index(drop=True)
        x = np.array([np.asarray(v, np.float64) for v in pdf["embedding"]])
        n = np.linalg.norm(x, axis=1)
        like = np.clip(np.divide(x @ x.T, n[:, None] * n[None, :], out=np.zeros((len(x), len(x))), where=(n[:, None] * n[None, :]) > 0), 0, 1)
        score = pdf["score"].to_numpy(np.float64)
        chosen, left, most = [0], list(range(1, len(pdf))), like[0].copy()
        while left:
            i = max(left, key=lambda j: (alpha * score[j] - (1 - alpha) * most[j], -j))
            left.remove(i)
            chosen.append(i)
            most = np.maximum(most, like[i])
        out = pdf.iloc[chosen][["query_id", "id"]].copy()
        out["new_rank"] = range(1, len(out) + 1)
        return out

    return df.select("query_id", "id", "rank", "score", "embedding").groupBy("query_id").applyInPandas(one, "query_id long, id long, new_rank long")


def diversity_penalty(df: DataFrame, weight: float = 0.3) -> DataFrame:
    """Score less ``weight`` times the largest cosine with a row ranked before; reordered."""
    out = _with_likeness(df, F.col("embedding"), cosine, F.array_max)
    return _ranked(out.withColumn("final_score", F.col("score") - weight * F.coalesce("likeness", F.lit(0.0))).drop("likeness"), 1 << 30)


def rank_changes(df: DataFrame) -> DataFrame:
    """How many rows moved by how many ranks."""
    return df.groupBy((F.col("new_rank") - F.col("rank")).cast("long").alias("rank_change")).agg(F.count("*").alias("n"))


def improvement(df: DataFrame, strategy: str) -> DataFrame:
    """One row: what reranking by ``strategy`` did: queries, rows, rows that rose and fell, mean change of score."""
    return df.agg(
        F.lit(strategy).alias("strategy"),
        F.countDistinct("query_id").alias("queries"),
        F.count("*").alias("rows"),
        F.count_if(F.col("new_rank") < F.col("rank")).alias("rose"),
        F.count_if(F.col("new_rank") > F.col("rank")).alias("fell"),
        F.round(F.avg(F.col("final_score") - F.col("score")), 6).alias("mean_change"),
    ).select("strategy", "queries", "rows", "rose", "fell", "mean_change")


def applied(df: DataFrame, strategy: str, enabled: bool = True, **options) -> DataFrame:
    """Reranked by ``strategy``, or, where reranking is off, all rows as they came."""
    return rerank(df, strategy, **options) if enabled else original(df, 1 << 30)
