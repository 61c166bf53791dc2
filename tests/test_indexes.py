"""The vector index and the inverted index against searches without them."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from corpusql.functions.text import terms
from corpusql.operators import inverted_index as ii
from corpusql.operators import vector_index as vi
from corpusql.operators import vector_search as vs

PAIRS = "id long, embedding array<double>"


def rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


def near_rows(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and x[1] == y[1] and x[3] == y[3] and abs(x[2] - y[2]) < 2e-9 for x, y in zip(a, b))


@pytest.fixture(scope="module")
def grouped(spark):
    """2,000 vectors around 40 directions, and what has no place among them."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 12))
    v = middle[rng.integers(0, 40, 2000)] + 0.15 * rng.normal(size=(2000, 12))
    odd = [(5000, None), (5001, []), (5002, [1.0, 2.0]), (5003, [0.0] * 12), (5004, [math.nan] * 12), (5005, [None] * 12), (None, [1.0] * 12)]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, PAIRS)


def asked(df):
    return df.where("id % 20 = 0 and id < 2000").select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"))


def test_vector_index(spark, grouped, tmp_path):
    index = vi.build(grouped, str(tmp_path / "ix"), sample=800)
    assert index.vectors == 2000 and index.dimension == 12 and 30 <= index.lists <= 45
    assert index.table(spark).count() == grouped.count()
    q, clean = asked(grouped), grouped.where("id is not null and (id < 2000 or id in (5002, 5003))")
    exact = vs.search(q, clean, 10)
    found = vi.search(index, q, 10)
    # Groups stand apart, so few lists do.
    assert index.probes <= 6 and index.recall >= 0.95
    r = vi.recall(found, exact).agg(F.sum("got") / F.sum("wanted")).first()[0]
    assert r >= 0.9
    true = {(x.query_id, x.id): x.score for x in vs.search(q, clean, 3000).collect()}
    assert all(abs(true[x.query_id, x.id] - x.score) < 2e-9 for x in found.collect())
    # All lists: the exact result.  In many blocks: the same.
    assert near_rows(rows(vi.search(index, q, 10, probes=index.lists)), rows(exact))
    assert near_rows(rows(vi.search(index, q, 10, block_bytes=2000)), rows(found))
    assert vi.load(spark, index.path) == index


def test_only_some_lists_are_read(spark, grouped, tmp_path):
    index = vi.build(grouped, str(tmp_path / "ix"), lists=30)
    one = asked(grouped).where("query_id = 40")
    plan = vi._block(index, one, 10, 2, None, 9)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    # Two lists and that of the vectors without one.
    assert filters.startswith("list#") and filters.count(",") == 2 and f"{vi.OTHER}" in filters


def test_vectors_are_added(spark, grouped, tmp_path):
    index = vi.build(grouped.where("id < 1900"), str(tmp_path / "ix"))
    vi.add(index, grouped.where("id between 1900 and 1999"))
    assert index.table(spark).count() == 2000
    q = asked(grouped).where("query_id >= 1900")
    found = vi.search(index, q, 1)
    assert {(r.query_id, r.id) for r in found.collect()} == {(i, i) for i in range(1900, 2000, 20)}


def test_odd_vectors(spark, grouped, tmp_path):
    """A vector of another length is found by queries of that length; nothing else is by them."""
    index = vi.build(grouped, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, [2.0, 4.0]), (2, None), (3, [1.0] * 5), (None, [1.0] * 12)], "query_id long, qv array<double>")
    assert [(r.query_id, r.id, r.score) for r in vi.search(index, q).collect()] == [(1, 5002, 1.0)]
    assert vi.search(index, q.limit(0)).count() == 0
    assert vi.search(index, asked(grouped), 10, threshold=1.1).count() == 0
    with pytest.raises(ValueError):
        vi.build(grouped.where("id = 5000"), str(tmp_path / "none"))
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], PAIRS)
    index = vi.build(same, str(tmp_path / "same"))
    assert [r.id for r in vi.search(index, same.limit(1).selectExpr("id AS query_id", "embedding AS qv"), 3).orderBy("rank").collect()] == [0, 1, 2]


# Keyword search.


def brute(chunks, queries, k, average="distinct", plus_one=False):
    from corpusql.functions import lexicon

    def split(text):
        import re

        return [w for w in (re.sub(r"[^a-z0-9_-]", "", x) for x in re.split(r"\s+", (text or "").lower())) if w]

    texts = [(i, split(c)) for i, c in chunks]
    n = len(texts)
    mean = sum(len(set(t)) if average == "distinct" else len(t) for _, t in texts) / n
    df = Counter(w for i, t in texts for w in set(t) if i is not None)
    out = []
    for qid, text in queries:
        qtf = Counter(w for w in split(text) if w not in lexicon.STOP_WORDS)
        scores = []
        for i, t in texts:
            tf = Counter(t)
            hit = [w for w in qtf if w in tf]
            if i is not None and hit:
                odds = lambda w: (n - df[w] + 0.5) / (df[w] + 0.5)
                s = sum(math.log(odds(w) + plus_one) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) * qtf[w] for w in hit)
                scores.append((-round(s, 9), i))
        out += [(qid, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_inverted_index(spark, tmp_path):
    """Frequent, rare, negative and repeated terms; chunks without terms, without text, without id; ties."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rare = lambda: rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randrange(1, 60))
    chunks = [(i, " ".join(rare()).title() + ("." if i % 3 else "")) for i in range(700)]
    chunks += [(i, "w7 w9 w7") for i in range(800, 840)] + [(900, None), (901, ""), (902, " .. "), (None, "w1 w2 w300")]
    table = spark.createDataFrame([(i, c, "x") for i, c in chunks], "id long, content string, term string")
    queries = [(1, "w300 w250"), (2, "w0"), (3, "the w7 W7 w9"), (4, "nothing here"), (5, ""), (6, None), (7, "w399 w0 w1 w2 w3 w4"), (8, "w10 w20 w30")]
    asked_ = spark.createDataFrame(queries, "query_id long, text string")
    for n, options in enumerate(({"size": 8}, {"size": 64, "average": "total", "buckets": 3})):
        index = ii.build(table, str(tmp_path / f"ix{n}"), "term", **options)
        for m, more in enumerate(({"ahead": 1}, {"ahead": 3, "plus_one": True})):
            got = rows(ii.search(index, asked_, str(tmp_path / f"q{n}{m}"), 5, **more))
            assert near_rows(got, brute(chunks, queries, 5, options.get("average", "distinct"), more.get("plus_one", False)))
    assert ii.load(spark, index.path) == index


def test_blocks_are_skipped(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    # A few chunks say much of what is asked for; the rest mention it.
    docs = docs.withColumn("content", F.when(F.col("id") % 20 == 0, F.concat(F.lit("zebra quagga okapi zebra quagga okapi "), F.substring("content", 1, 80))).when(F.col("id") % 2 == 0, F.concat("content", F.lit(" zebra"))).otherwise(F.col("content")))
    index = ii.build(docs.withColumn("k", F.col("id") % 20), str(tmp_path / "ix"), "k", size=4)
    q = spark.createDataFrame([(1, "zebra quagga okapi")], "query_id long, text string")
    p = ii.plan(index, q, str(tmp_path / "q"), k=5, ahead=2)
    r = ii.skipped(p).first()
    assert r.read < r.blocks / 2
    want = brute([(x.id, x.content) for x in docs.collect()], [(1, "zebra quagga okapi")], 5)
    assert near_rows(rows(ii.search(index, q, str(tmp_path / "q2"), 5, ahead=2)), want)
    empty = ii.build(docs.limit(0).withColumn("k", F.lit(1)), str(tmp_path / "none"), "k")
    assert ii.search(empty, q, str(tmp_path / "q3")).count() == 0


def test_blocks_stay_where_they_lie(spark, tmp_path):
    """Bounds and scores are added in the buckets; no exchange carries the blocks or what a chunk's terms score."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    index = ii.build(docs, str(tmp_path / "ix"), "lang", buckets=3)
    q = spark.createDataFrame([(1, "the of and"), (2, "ing tion zebra")], "query_id long, text string")
    p = ii.plan(index, q, str(tmp_path / "q"))
    plan = p.scores._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "Bucketed: true" in plan and all("range" in line.split("hashpartitioning(")[1] for line in moved)
    # Blocks and pairs of (query, range) are not dealt anew: at most the first ranges are.
    assert len(moved) <= 2
    # Another session finds the table by its path.
    other = spark.newSession()
    assert sorted(ii.load(other, index.path).blocks(other).select("term", "range").collect()) == sorted(index.blocks(spark).select("term", "range").collect())


def test_terms_of_awkward_texts(spark):
    """Cleaned as a whole, texts have the terms that their words have cleaned one by one."""
    import re

    texts = ["", None, " .. a.b  !c\t-d_\n", "X\x00Y \x1fz\x0b1\x0c2\r3", "Straße 日本 ÀB d\u00a0e f\u2003g", "`a` {b} [c]^d~\x7f @e /f :g ,h", "\U0001f600x y\U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for r in df.select("t", terms(F.col("t")).alias("x")).collect():
        want = None if r.t is None else [w for w in (re.sub(r"[^a-z0-9_-]", "", x) for x in re.split(r"[ \t\n\x0b\f\r]+", r.t.lower())) if w]
        assert r.x == want
