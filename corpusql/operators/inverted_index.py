"""Keyword search over a whole corpus: an inverted index in blocks, and top-k that skips blocks.

``build`` numbers the chunks (neighbours in ``cluster`` columns side by side), cuts them into
ranges of ``size`` and writes one row for each term and range: the postings in arrays, and
beside them how many there are and the largest term weight among them.  ``search`` first
reads only these small columns.  The sum of a query's largest weights in a range bounds the
score of every chunk in it, so each query's most promising ranges are scored first, its k-th
best score there is a bar, and ranges whose bound lies under the bar are never scored: their
chunks can't come in.  The result is exactly that of scoring everything.  Rare terms and
short queries skip most; a long query of frequent words reads nearly all of its blocks.

The index is a table bucketed by range and sorted by term.  All blocks of a range lie in one
bucket, so bounds and scores are added where the blocks are read; what moves is the texts
when they are dealt by range, and the best ranges and rows of each task.

The statistics of BM25 (chunks, mean length, frequencies) are those of the whole corpus.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusql.functions.text import terms
from corpusql.operators.bm25 import idf, query_terms

BLOCKS = "term string, range long, n int, top double, ids array<long>, tfs array<int>, sizes array<int>"
INFO = "chunks long, mean double, buckets int, k1 double, b double"
EPSILON = 1e-6  # more than sums of doubles in another order, and rounding, can differ by
BUCKET_CHUNKS = 20_000  # in a bucket, where there are so many
FEW = 10  # terms that are looked up in the sorted files


def _table(path: str) -> str:
    """The name in the session's catalog of the bucketed table at a path."""
    return f"inverted_{hashlib.md5(path.encode()).hexdigest()}"


def _write(df: DataFrame, path: str, buckets: int, *order: str) -> None:
    df.write.format("parquet").bucketBy(buckets, "range").sortBy(*order).option("path", path).saveAsTable(_table(path))


@dataclass(frozen=True)
class Index:
    path: str
    chunks: int
    mean: float  # length of a chunk, as the scores count it
    buckets: int
    k1: float
    b: float

    def blocks(self, spark: SparkSession) -> DataFrame:
        at = f"{self.path}/blocks"
        if not spark.catalog.tableExists(_table(at)):  # of another session
            quoted = at.replace("'", "\\'")
            spark.sql(f"CREATE TABLE {_table(at)} ({BLOCKS.replace('range ', '`range` ')}) USING parquet CLUSTERED BY (`range`) SORTED BY (term) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")
        return spark.table(_table(at))

    def weight(self, tf: Column, size: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size / self.mean))


def load(spark: SparkSession, path: str) -> Index:
    return Index(path, *spark.read.schema(INFO).parquet(f"{path}/info").first())


def build(chunks: DataFrame, path: str, *cluster: str, size: int = 32, buckets: int | None = None, average: str = "distinct", k1: float = 1.2, b: float = 0.75) -> Index:
    """Write an index of ``chunks`` (``id, content``; an id once) below ``path``.

    ``average``: the mean length counts distinct terms of a chunk or all of them (``total``);
    a chunk's own length counts all.  Chunks without terms count in the statistics; a null
    id has no postings.  ``buckets``: of ranges, by default one for each ``BUCKET_CHUNKS``
    and no fewer than the session's shuffle partitions.
    """
    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*cluster, "id"]
    t = terms(F.coalesce("content", F.lit("")))
    length = F.size(F.array_distinct(t)) if average == "distinct" else F.size(t)
    total, lengths = chunks.agg(F.count("*"), F.sum(length)).first()
    index = Index(path, total, lengths / total if total and lengths else 1.0, buckets or max(n, -(-total // BUCKET_CHUNKS)), k1, b)
    # Numbers grow within a partition and have gaps between them; no range lies in two partitions.
    ordered = chunks.where("id is not null").select("id", *cluster, "content").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ordered.select("id", "content", F.floor(F.monotonically_increasing_id() / size).alias("range"))
    # Dealt by range as texts, once: what follows groups by range and more, and stays where it is.
    dealt = ranged.repartition(index.buckets, "range").select("id", "range", t.alias("t"))
    # Outer: else a filter on the terms is put before the dealing, and each text is split twice.
    each = dealt.select("id", "range", F.size("t").alias("size"), F.explode_outer("t").alias("term")).where("term is not null")
    postings = each.groupBy("range", "term", "id", "size").agg(F.count("*").cast("int").alias("tf"))
    weighed = postings.withColumn("w", index.weight(F.col("tf"), F.col("size")))
    listed = weighed.groupBy("range", "term").agg(F.count("*").cast("int").alias("n"), F.max("w").alias("top"), F.sort_array(F.collect_list(F.struct("id", "tf", "size"))).alias("p"))
    blocks = listed.select("term", "range", "n", "top", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.size").alias("sizes"))
    # Sorted files let readers skip by the term.
    _write(blocks, f"{path}/blocks", index.buckets, "term")
    spark.createDataFrame([(index.chunks, index.mean, index.buckets, k1, b)], INFO).coalesce(1).write.parquet(f"{path}/info")
    return index


@dataclass(frozen=True)
class Plan:
    """The steps of a search: ``asked`` (query_id, term, factor), ``bounds`` (query_id, range, bound, blocks) and ``read``, the ranges that were read."""

    asked: DataFrame
    bounds: DataFrame
    read: DataFrame
    scores: DataFrame


def plan(index: Index, queries: DataFrame, path: str, k: int = 10, ahead: int = 32, plus_one: bool = False, digits: int = 9) -> Plan:
    """What a search needs and finds; tables that are read again are written below ``path``."""
    spark = queries.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    wanted = kept(query_terms(queries), "terms")
    blocks = index.blocks(spark)
    few = [r.term for r in wanted.select("term").distinct().limit(FEW + 1).collect()]
    mine = blocks.where(F.col("term").isin(few)) if len(few) <= FEW else blocks
    df = mine.select("term", "n").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    factor = idf(F.lit(index.chunks), F.col("df"), plus_one) * F.col("qtf")
    asked = kept(wanted.join(df, "term").select("query_id", "term", factor.alias("factor")), "asked")
    # A term that speaks against a chunk need not be in it.
    bound = F.sum(F.greatest(F.col("factor") * F.col("top"), F.lit(0.0)))
    at = f"{path}/bounds"
    _write(mine.select("term", "range", "top").join(asked, "term").groupBy("query_id", "range").agg(bound.alias("bound"), F.count("*").alias("blocks")), at, index.buckets, "range")
    bounds = spark.table(_table(at))
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    first = kept(bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= ahead).select("query_id", "range"), "first")

    def scored(ranges: DataFrame) -> DataFrame:
        """Scores of all chunks of ``ranges`` (query_id, range) with a term of the query."""
        # By range alone, as the blocks lie; neither side is sorted.
        here = ranges.groupBy("range").agg(F.collect_list("query_id").alias("for"))
        hits = mine.join(here.hint("shuffle_hash"), "range").join(asked, "term").where(F.array_contains("for", F.col("query_id")))
        p = hits.select("range", "query_id", "factor", F.explode(F.arrays_zip("ids", "tfs", "sizes")).alias("p"))
        score = F.round(F.sum(F.col("factor") * index.weight(F.col("p.tfs"), F.col("p.sizes"))), digits)
        return p.groupBy("range", "query_id", F.col("p.ids").alias("id")).agg(score.alias("score")).drop("range")

    early = kept(scored(first), "early")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    bar = early.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select("query_id", F.col("score").alias("bar"))
    open_ = bounds.join(kept(bar, "bar"), "query_id", "left").where(F.col("bar").isNull() | (F.col("bound") + EPSILON >= F.col("bar"))).select("query_id", "range")
    more = open_.join(first, ["query_id", "range"], "left_anti")
    return Plan(asked, bounds, first.unionByName(more), early.unionByName(scored(more)))


def search(index: Index, queries: DataFrame, path: str, k: int = 10, **options) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best chunks that share a term with each query (``query_id, text``).

    ``path``: a new folder for what the search writes between its steps.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return plan(index, queries, path, k, **options).scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def skipped(p: Plan) -> DataFrame:
    """``query_id, blocks, read``: blocks of the query's terms, and those among them whose postings were read."""
    each = p.bounds.join(p.read.withColumn("read", F.lit(1)), ["query_id", "range"], "left")
    return each.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("read") == 1, F.col("blocks")).otherwise(0)).alias("read"))
