"""Exact vector search of many queries at once.

A block of queries whose size is bounded goes to all executors; each task multiplies Arrow
batches with it and keeps the best ``k`` for each query, so what is shuffled is at most ``k``
rows a query and task, whatever the number of vectors.  More queries than one block are
never collected: queries and vectors are dealt into blocks and each pair of blocks meets in
one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusql.functions import vectors as V

METRICS = ("cosine", "euclidean", "manhattan", "dot")


def similarity(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of all rows of ``x`` for all rows of ``q``."""
    if metric == "dot":
        return np.clip(x @ q.T, 0, 1)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        c = np.clip(np.divide(x @ q.T, n, out=np.zeros((len(x), len(q))), where=n > 0), -1, 1)
        return 1 - np.clip(1 - c, 0, 2) / 2
    out = np.empty((len(x), len(q)))
    for j, v in enumerate(q):  # one query at a time: memory stays that of the batch
        d = x - v
        out[:, j] = np.sqrt((d * d).sum(1)) if metric == "euclidean" else np.abs(d).sum(1)
    return 1 / (1 + out)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", threshold: float | None = None, digits: int = 9, block_bytes: int = 32 << 20, unlike: str | None = None) -> DataFrame:
    """``query_id, id, score, rank``: for each query its ``k`` best vectors.

    ``unlike``: a column of both tables; vectors that agree with the query in it, and the
    vector with the query's own id, are left out (null agrees with nothing).

    ``queries``: ``query_id`` (long), ``qv``; ``vectors``: ``id`` (long), ``embedding``.  Scores
    are rounded to ``digits`` before ranking, ties go to the smaller id.  Null vectors,
    vectors with an entry that is null or not finite, and vectors of another length than the
    query's match nothing.  Queries of ``block_bytes``
    in all, with ``k`` rows that take four times as much at most, are sent to all executors;
    of more, see the module.
    """
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    q = queries.where("qv is not null").select(F.col("query_id").cast("long").alias("id"), V.doubles(F.col("qv")).alias("v"), _code(unlike))
    x = vectors.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("embedding")).alias("v"), _code(unlike))
    size, count = q.agg(F.coalesce(F.sum(8 * F.size("v") + 24), F.lit(0)), F.count("*")).first()
    how = (k, metric, threshold, digits, bool(unlike))
    blocks = max(1, -(-size // block_bytes), -(-16 * k * count // (4 * block_bytes)))
    found = _sent(q, x, how) if blocks == 1 else _dealt(q, x, how, min(blocks, count), block_bytes)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


FOUND = "query_id long, id long, score double"


def _code(unlike: str | None) -> Column:
    return (F.when(F.col(unlike).isNotNull(), F.xxhash64(unlike)) if unlike else F.lit(None).cast("long")).alias("code")


def _sent(q: DataFrame, x: DataFrame, how: tuple) -> DataFrame:
    """One bounded block of queries, sent to all executors."""
    shared = x.sparkSession.sparkContext.broadcast(q.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, *how)
        for b in batches:
            best.see(b.column(0), b.column(1), b.column(2))
        yield from best.found()

    return x.mapInArrow(run, FOUND)


def _dealt(q: DataFrame, x: DataFrame, how: tuple, n: int, block_bytes: int) -> DataFrame:
    """``n`` blocks of queries and blocks of vectors, each pair of them in one task."""
    total = x.agg(F.sum(8 * F.size("v") + 24)).first()[0] or 0
    m = max(1, -(-total // block_bytes))
    q = q.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    x = x.where("id is not null").withColumn("p", F.pmod(F.xxhash64("id"), F.lit(m))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def pair(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        best = Best(queries, *how)
        for b in vectors.to_batches(max_chunksize=10_000):
            best.see(b.column("id"), b.column("v"), b.column("code"))
        return pa.Table.from_batches(best.found(), schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    return q.groupBy("p", "b").cogroup(x.groupBy("p", "b")).applyInArrow(pair, FOUND)


class Best:
    """The best ``k`` vectors so far for each of some queries (``id, v, code``).

    They stand in two matrices, ``k`` a query; scores are worked on in tiles of a fixed
    number of cells, and what comes in is merged into them a bounded number of rows at a
    time, so that memory is that of the queries and their ``k`` rows, whatever the number of
    vectors.
    """

    CELLS = 1 << 19  # of a tile of scores
    ROWS = 2048  # vectors in it
    FRESH = 20_000  # rows that wait to be merged

    def __init__(self, queries: pa.Table, k: int, metric: str, threshold: float | None, digits: int, unlike: bool):
        self.k, self.metric, self.digits, self.unlike = k, metric, digits, unlike
        v = queries.column("v").combine_chunks()
        sizes = np.asarray(v.value_lengths())
        code = queries.column("code").combine_chunks()
        self.ids = np.asarray(queries.column("id").combine_chunks()).astype(np.int64)
        self.code, self.coded = np.asarray(code.fill_null(0)).astype(np.int64), np.asarray(code.is_valid())
        self.by_size = {}
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            same = v if len(at) == len(sizes) else v.take(pa.array(at))
            self.by_size[n] = at, np.asarray(same.flatten(), np.float64).reshape(len(at), n)
        #: What a score must reach to matter: the threshold, and the k-th best once there are k; of equal ones the ids up to ``last`` do.
        self.least = np.full(len(self.ids), -np.inf if threshold is None else threshold)
        self.last = np.full(len(self.ids), np.iinfo(np.int64).max)
        self.count = np.zeros(len(self.ids), np.int64)
        self.best = np.zeros((len(self.ids), k), np.int64), np.zeros((len(self.ids), k))  # vectors and scores, the best first
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, vector, score
        self.rows = 0

    def see(self, ids: pa.Array, vectors: pa.Array, code: pa.Array, only: np.ndarray | None = None) -> None:
        """Take some vectors into account, for all queries or ``only`` for those."""
        sizes = np.asarray(vectors.value_lengths().fill_null(-1))
        known = np.asarray(ids.is_valid())
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        coded, code = np.asarray(code.is_valid()), np.asarray(code.fill_null(0)).astype(np.int64)
        for n, (of, q) in self.by_size.items():
            mine = np.arange(len(of)) if only is None else np.flatnonzero(only[of])
            rows = np.flatnonzero((sizes == n) & known)
            if not len(mine) or not len(rows):
                continue
            for a in range(0, len(rows), self.ROWS):
                at = rows[a : a + self.ROWS]
                x = np.asarray(vectors.take(pa.array(at)).flatten(), np.float64).reshape(len(at), n)
                if not (finite := np.isfinite(x).all(1)).all():
                    x, at = x[finite], at[finite]
                step = max(1, self.CELLS // max(1, len(at)))
                for c in range(0, len(mine) if len(at) else 0, step):
                    some = mine[c : c + step]
                    self._tile(x, ids[at], code[at], coded[at], of[some], q[some])

    def _tile(self, x: np.ndarray, ids: np.ndarray, code: np.ndarray, coded: np.ndarray, of: np.ndarray, q: np.ndarray) -> None:
        s = similarity(self.metric, x, q)
        np.round(s, self.digits, out=s)
        least = self.least[of]
        keep = s >= least[None, :]
        if self.unlike:
            keep &= ids[:, None] != self.ids[of][None, :]
            keep &= ~(coded[:, None] & self.coded[of][None, :] & (code[:, None] == self.code[of][None, :]))
        if 0 < self.k < len(s) and np.count_nonzero(keep) > 2 * self.k * len(of):
            # Before the bars are up: of a tile no more than its k best, and what equals the last of them.
            s[~keep] = -np.inf
            keep &= s >= np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k][None, :]
        i, j = np.nonzero(keep)
        near = (s[i, j] > least[j]) | (ids[i] <= self.last[of[j]])
        self.fresh.append((of[j[near]], ids[i[near]], s[i[near], j[near]]))
        self.rows += int(near.sum())
        if self.rows > self.FRESH:
            self.prune()

    def prune(self) -> None:
        """Of what is held and what is new only the best stay, and what is worse than the k-th of a query no longer comes in."""
        if not self.rows:
            return
        q, i, s = (np.concatenate(x) for x in zip(*self.fresh))
        self.fresh, self.rows = [], 0
        met = np.unique(q)
        held = np.arange(self.k)[None, :] < self.count[met][:, None]
        q = np.concatenate([np.repeat(met, self.count[met]), q])
        i = np.concatenate([self.best[0][met][held], i])
        s = np.concatenate([self.best[1][met][held], s])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        stay = place < self.k
        q, i, s, place = q[stay], i[stay], s[stay], place[stay]
        self.best[0][q, place], self.best[1][q, place] = i, s
        self.count[met] = np.bincount(np.searchsorted(met, q), minlength=len(met))
        full = place == self.k - 1
        self.least[q[full]], self.last[q[full]] = s[full], i[full]

    def found(self) -> Iterator[pa.RecordBatch]:
        self.prune()
        step = max(1, 100_000 // max(1, self.k))
        for a in range(0, len(self.ids), step):
            held = np.arange(self.k)[None, :] < self.count[a : a + step, None]
            of = np.repeat(self.ids[a : a + step], self.count[a : a + step])
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(self.best[0][a : a + step][held]), pa.array(self.best[1][a : a + step][held])], names=["query_id", "id", "score"])


def score_pairs(pairs: DataFrame, metric: str = "cosine", out: str = "score") -> DataFrame:
    """Scores of given pairs (``qv``, ``embedding``), inside the JVM."""
    return pairs.withColumn(out, V.score(metric, F.col("qv"), F.col("embedding")))


def find_similar(queries: DataFrame, vectors: DataFrame, k: int = 10, threshold: float | None = 0.7, unlike: str | None = None, **options) -> DataFrame:
    """As ``search`` without the query's own vector and, with ``unlike``, without those that agree in that column."""
    if unlike:
        return search(queries, vectors, k, threshold=threshold, unlike=unlike, **options)
    found = search(queries, vectors, k + 1, threshold=threshold, **options).where("id <> query_id").drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def collection_info(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("points_count"), F.count("embedding").alias("vectors_count"), F.max(F.size("embedding")).cast("long").alias("dimension"))


def of_documents(chunks: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The chunks of given documents, however many these are."""
    return chunks.join(documents.select(key).distinct(), key, "left_semi")


def filters(document_ids: list | None = None, tags: list[str] | None = None, category: str | None = None, chunk_index: tuple[int, int] | None = None, length: tuple[int, int] | None = None, created_after=None, created_before=None, metadata: dict[str, str] | None = None) -> Column:
    """A predicate over ``document_id, tags, category, chunk_index, content, created_at, metadata`` (JSON).

    A row without the value asked for is left out.
    """
    f = F.lit(True)
    if document_ids is not None:
        f = f & F.col("document_id").isin(list(document_ids))
    if tags:
        f = f & F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False))
    if category is not None:
        f = f & F.coalesce(F.col("category") == category, F.lit(False))
    if chunk_index:
        f = f & F.col("chunk_index").between(*chunk_index)
    if length:
        f = f & F.length("content").between(*length)
    if created_after is not None:
        f = f & (F.col("created_at") >= F.lit(created_after))
    if created_before is not None:
        f = f & (F.col("created_at") <= F.lit(created_before))
    for k, v in (metadata or {}).items():
        f = f & F.coalesce(F.get_json_object("metadata", f"$.{k}") == v, F.lit(False))
    return f
