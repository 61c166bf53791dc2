"""An approximate vector index: vectors dealt into lists around centroids, of which a query reads few.

``build`` fits the centroids on a bounded sample, assigns every vector to its nearest one and
writes the table partitioned by list; ``search`` ranks the centroids for each query, reads
only the partitions of the lists that are asked for, and scores what they hold exactly.  So
every score is a true one, and what can be missed are neighbours in lists that weren't read.
How many lists a query needs is measured when the index is built: the neighbours that an
exact search gives a few sample vectors must lie in the nearest ``probes`` lists with the
share asked for.  On vectors without any structure that can be half of the lists.

Vectors of another length than the centroids', and null ones, stand in a list of their own
that every query reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusql.functions import vectors as V
from corpusql.operators import vector_search as vs

OTHER = -1  # the list of vectors that have no centroid
VECTORS = "id long, embedding array<double>, list int"
CENTROIDS = "list int, centroid array<double>"
INFO = "vectors long, dimension int, lists int, probes int, recall double, metric string"
SAMPLE_BYTES = 128 << 20


@dataclass(frozen=True)
class Index:
    path: str
    vectors: int
    dimension: int
    lists: int
    probes: int
    recall: float
    metric: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(VECTORS).parquet(f"{self.path}/vectors")

    def centroids(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(CENTROIDS).parquet(f"{self.path}/centroids")


def load(spark: SparkSession, path: str) -> Index:
    return Index(path, *spark.read.schema(INFO).parquet(f"{path}/info").first())


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = 20_000, target: float = 0.95, trials: int = 128, k: int = 10, metric: str = "cosine", most_lists: int = 4096, seed: int = 1) -> Index:
    """Write an index of ``vectors`` (``id, embedding``) below ``path``.

    ``lists``: the root of the number of vectors, ``most_lists`` at most, where not given.
    The centroids are fitted on ``sample`` vectors at most (fewer if these take over 128 MB),
    those with the smallest hashes of their ids; every vector is assigned.  ``trials``
    vectors of the sample tell how many lists give ``target`` of the ``k`` nearest.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("embedding")).alias("embedding"))
    usable = x.where(F.col("id").isNotNull() & F.coalesce(V.valid(F.col("embedding")), F.lit(False)) & (V.norm(F.col("embedding")) > 0))
    common = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        raise ValueError("no vectors to fit an index on")
    d, n = common
    usable = usable.where(F.size("embedding") == d)
    some = usable.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(trials, min(sample, SAMPLE_BYTES // (8 * d))))
    some.write.parquet(f"{path}/sample")
    some = spark.read.schema("id long, embedding array<double>").parquet(f"{path}/sample")
    wanted = lists or max(1, min(most_lists, round(n**0.5)))
    fitted = KMeans(k=wanted, seed=seed, maxIter=15, distanceMeasure="cosine", featuresCol="v").fit(some.select(array_to_vector("embedding").alias("v"))) if wanted > 1 else None
    centroids = np.array(fitted.clusterCenters()) if fitted else np.ones((1, d))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], CENTROIDS).coalesce(1).write.parquet(f"{path}/centroids")
    # Lists are brought together and large ones split by adaptive execution, as their sizes are known after the shuffle.
    assigned(x, centroids, metric).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/vectors")
    index = Index(path, n, d, len(centroids), len(centroids), 1.0, metric)
    probes, recall = _probes(index, some.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(trials), x, target, k)
    spark.createDataFrame([(n, d, len(centroids), probes, recall, metric)], INFO).coalesce(1).write.parquet(f"{path}/info")
    return load(spark, path)


def assigned(x: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """``x`` (id, embedding) with the ``list`` of each; the centroids (``most_lists`` at most) go to all executors."""
    shared = x.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            v = b.column(1)
            place = np.full(len(v), OTHER, np.int32)
            rows = np.flatnonzero(np.asarray(v.value_lengths().fill_null(-1)) == c.shape[1])
            for i in range(0, len(rows), step := max(1, (1 << 22) // len(c))):
                at = rows[i : i + step]
                part = np.asarray(v.take(pa.array(at)).flatten().fill_null(np.nan), np.float64).reshape(len(at), c.shape[1])
                at, part = at[(ok := np.isfinite(part).all(1))], part[ok]
                place[at] = vs.similarity(metric, part, c).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(place)], names=["id", "embedding", "list"])

    return x.mapInArrow(run, VECTORS)


def _probes(index: Index, trials: DataFrame, x: DataFrame, target: float, k: int) -> tuple[int, float]:
    """How many of the nearest lists hold ``target`` of the trials' neighbours, and the share that they then hold."""
    spark = x.sparkSession
    q = trials.select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"))
    near = vs.find_similar(q, x, k, threshold=None, metric=index.metric).select("query_id", "id")
    order = vs.search(q, index.centroids(spark).select(F.col("list").alias("id"), F.col("centroid").alias("embedding")), index.lists, index.metric).select("query_id", F.col("id").cast("int").alias("list"), F.col("rank").alias("needed"))
    places = index.table(spark).where(F.col("list") != OTHER).select("id", "list")
    rows = near.join(places, "id").join(order, ["query_id", "list"]).groupBy("needed").count().orderBy("needed").collect()  # a row a list at most
    total, held = sum(r["count"] for r in rows), 0
    for r in rows:
        held += r["count"]
        if held >= target * total:
            return r["needed"], held / total
    return index.lists, 1.0


def add(index: Index, vectors: DataFrame) -> None:
    """Append vectors to their lists; the ids must be new."""
    spark = vectors.sparkSession
    centroids = np.array([r.centroid for r in index.centroids(spark).orderBy("list").collect()])
    x = vectors.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("embedding")).alias("embedding"))
    assigned(x, centroids, index.metric).hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{index.path}/vectors")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, threshold: float | None = None, digits: int = 9, block_bytes: int = 32 << 20) -> DataFrame:
    """``query_id, id, score, rank`` as the exact search gives them, from the ``probes`` nearest lists of each query.

    Queries go to the executors in blocks of ``block_bytes``; a block reads the lists that its
    queries need and no other (partition filters), once.
    """
    spark = queries.sparkSession
    q = queries.where("qv is not null and query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("qv")).alias("qv"))
    size = q.agg(F.sum(8 * F.size("qv") + 24)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for b in range(blocks):
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else q
        part = _block(index, own, k, probes or index.probes, threshold, digits)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(index: Index, q: DataFrame, k: int, probes: int, threshold: float | None, digits: int) -> DataFrame:
    """One bounded block of queries against the lists that they need."""
    spark = q.sparkSession
    near = vs.search(q, index.centroids(spark).select(F.col("list").alias("id"), F.col("centroid").alias("embedding")), probes, index.metric).groupBy("query_id").agg(F.sort_array(F.collect_list(F.col("id").cast("int"))).alias("lists"))
    asked = q.join(near, "query_id", "left").select(F.col("query_id").alias("id"), F.col("qv").alias("v"), F.lit(None).cast("long").alias("code"), F.coalesce("lists", F.array().cast("array<int>")).alias("lists")).toArrow()
    of = asked.column("lists").combine_chunks()
    who, which = np.repeat(np.arange(len(of)), np.asarray(of.value_lengths())), np.asarray(of.flatten())
    order = np.argsort(which, kind="stable")
    names, first = np.unique(which[order], return_index=True)
    wanted = sorted({*names.tolist(), OTHER})
    asks = {x: np.zeros(len(of), bool) for x in wanted}
    for x, some in zip(names.tolist(), np.split(who[order], first[1:])):
        asks[x][some] = True
    asks[OTHER][:] = True
    shared = spark.sparkContext.broadcast((asked.drop_columns(["lists"]), asks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, asks = shared.value
        best = vs.Best(table, k, index.metric, threshold, digits, False)
        for b in batches:
            lists = np.asarray(b.column(2))
            for x in np.unique(lists).tolist():
                at = pa.array(np.flatnonzero(lists == x))
                best.see(b.column(0).take(at), b.column(1).take(at), pa.nulls(len(at), pa.int64()), asks[x])
        yield from best.found()

    return index.table(spark).where(F.col("list").isin(wanted)).select("id", "embedding", "list").mapInArrow(run, vs.FOUND)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, wanted, got``: the rows of the exact search, and how many of them were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("got"))
