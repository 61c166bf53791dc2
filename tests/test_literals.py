"""Small cases with results worked out by hand from the definitions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.functions import query_text as Q
from corpusql.functions import relevance as R
from corpusql.functions import text as T
from corpusql.functions import validation as V
from corpusql.functions import vectors as vec
from corpusql.operators import answers, bm25, chunking, governance as g, ranking, rerank, vector_search as vs


def value(spark, column, **literals):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()] or [F.lit(0).alias("_")])
    return df.select(column.alias("x")).first()["x"]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.mark.parametrize("metric,a,b,want", [("cosine", (1, 0, 0), (0, 1, 0), 0.5), ("cosine", (1, 0, 0), (1, 0, 0), 1.0), ("cosine", (0, 0), (1, 0), 0.5), ("euclidean", (1, 0, 0), (0, 1, 0), 1 / (1 + math.sqrt(2))), ("manhattan", (1, 2), (2, 4), 0.25), ("dot", (1, 2), (2, 4), 1.0)])
def test_metrics(spark, metric, a, b, want):
    assert value(spark, vec.score(metric, arr(*a), arr(*b))) == pytest.approx(want)
    assert vs.similarity(metric, np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(want)


def test_wrong_size_and_mock(spark):
    with pytest.raises(Exception, match="expected 3"):
        value(spark, vec.same_size(arr(1, 2), 3))
    v = value(spark, vec.mock_embedding(F.lit("abc"), 16))
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1.0)


def test_hybrid_of_two_chunks(spark):
    q = spark.createDataFrame([(1, "machine learning algorithms", [0.1, 0.2, 0.3, 0.4])], "query_id long, text string, qv array<double>")
    c = spark.createDataFrame([(1, 1, "Machine learning and artificial intelligence are related fields", [0.1, 0.2, 0.3, 0.4]), (1, 2, "The cat sat on the mat quietly", [0.5, 0.6, 0.7, 0.8])], "query_id long, id long, content string, embedding array<double>")
    k = {r.id: r.bm25 for r in bm25.bm25(q, c).collect()}
    assert k == {1: 0.0, 2: 0.0}
    s = vs.score_pairs(c.join(q, "query_id")).select("id", vec.cosine(F.col("qv"), F.col("embedding")).alias("v"), bm25.blend(vec.cosine(F.col("qv"), F.col("embedding")), F.lit(0.0), 0.6, 0.4).alias("h"))
    got = {r.id: (round(r.v, 6), round(r.h, 6)) for r in s.collect()}
    assert got == {1: (1.0, 0.6), 2: (0.968864, 0.581318)}


def test_bm25_of_three_chunks(spark):
    q = spark.createDataFrame([(1, "machine learning algorithms")], "query_id long, text string")
    texts = ["The quick brown fox jumps over the lazy dog", "Machine learning algorithms are powerful tools", "Natural language processing enables text analysis"]
    c = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "query_id long, id long, content string")
    got = {r.id: round(r.bm25, 6) for r in bm25.bm25(q, c).collect()}
    assert got == {0: 0.0, 1: 1.597843, 2: 0.0}
    assert round(bm25.corpus_stats(c, "query_id").first()["avgdl"], 6) == 6.666667


def test_words(spark):
    assert value(spark, T.preprocess(F.lit("  Hello, WORLD!!! How are you?  "))) == "hello, world!!! how are you?"
    assert value(spark, T.word_count(F.lit("  hello   world  test  "))) == 3 and value(spark, T.word_count(F.lit(""))) == 0
    assert [value(spark, T.language(F.lit(s))) for s in ("The quick brown fox jumps over the lazy dog", "El perro come en la casa y el gato duerme", "Le renard brun saute par-dessus le chien paresseux", "")] == ["en", "es", "es", "unknown"]
    assert value(spark, T.pdf_date(F.lit("D:20240101120000"))) == dt.datetime(2024, 1, 1, 12)
    assert value(spark, T.mime(F.lit("a/b.HTML"))) == "text/html" and value(spark, T.mime(F.lit("x"))) == "application/octet-stream"
    assert value(spark, T.truncate(F.lit("one two three"), 9)) == "one two"
    assert value(spark, T.front_matter(F.lit("---\ntitle: A: b\ntags: x\n---\nrest"))) == {"title": "A: b", "tags": "x"}
    assert value(spark, T.front_matter(F.lit("no"))) is None
    assert value(spark, T.markdown_title(F.lit("x\n# Head\ny"))) == "Head"


def test_validation(spark):
    def check(t, kind="txt"):
        return value(spark, V.validate(F.lit(t), F.lit(kind)))

    assert check("This is valid content.")["valid"] and not check("")["valid"]
    assert not check("Hello <script>alert('xss')</script> world")["valid"] and not check("Valid content", "exe")["valid"]
    s = check("My SSN is 123-45-6789 and email is test@example.com")
    assert s["sanitised"] == "My SSN is [REDACTED] and email is [REDACTED]" and s["warnings"] == ["sensitive data"]
    assert check("  Hello    world  \n\n  with   extra   spaces  ")["sanitised"] == "Hello world with extra spaces"
    q = [value(spark, V.quality(F.lit(t))) for t in (" ".join(["word"] * 10), "Hi. Ok. Yes. No. Maybe. Sure. Fine. Good. Bad.", "123 456 789 !@# $%^ &*() 123 456 789", "")]
    assert q == [85.0, 95.0, 80.0, 95.0]


def test_query_texts(spark):
    assert [value(spark, Q.classify(F.lit(t))) for t in ("What is Rust?", "Show me all documents", "API documentation error")] == ["Question", "Command", "Technical"]
    assert value(spark, Q.issues(F.lit("Hi"))) == ["TooShort"] and value(spark, Q.issues(F.lit(""))) == ["EmptyQuery"]
    assert value(spark, Q.issues(F.lit("two  spaces"))) == ["ExcessiveWhitespace"]
    n = [(x["term"], x["place"]) for x in value(spark, Q.negations(F.lit("cannot open file without errors today")))]
    assert n == [("open", 3), ("open", 0), ("errors", 17)]
    a = value(spark, Q.acronyms(F.lit("REST API documentation")))
    assert "representational state transfer" in a and "application programming interface" in a and "REST" in a and "API" in a
    k = value(spark, Q.analysis(F.lit("How to implement machine learning algorithms?")))
    assert (k["type"], k["intent"], k["complexity"]) == ("Procedural", "ProblemSolving", "Moderate")
    assert value(spark, Q.analysis(F.lit("Python vs Java for machine learning")))["type"] == "Comparative"
    assert value(spark, Q.analysis(F.lit("What are the latest developments in AI?")))["temporal"]
    assert value(spark, Q.synonyms(F.lit("fast database"))) == ["quick", "rapid", "speedy", "db", "datastore", "repository"]
    assert value(spark, Q.entities(F.lit("the Acme Corp of New York"))) == ["Acme Corp", "New York"]
    assert value(spark, Q.without_negations(F.lit("no error in the code"))) == "no success in the code"


def test_relevance(spark):
    assert value(spark, T.jaccard(T.words(F.lit("machine learning algorithms")), T.words(F.lit("deep learning networks")))) == pytest.approx(0.2)
    assert value(spark, R.structure(F.lit("# A\n- b"))) == pytest.approx(0.8)
    long = "This is a long and well formed text. It has more than ten words in it. It also has more than one hundred bytes of text."
    assert value(spark, R.rerank_quality(F.lit(long))) == pytest.approx(0.9) and value(spark, R.rerank_quality(F.lit("Short text"))) == pytest.approx(0.3)


@pytest.mark.parametrize("scores,want", [([0.9], 0.85), ([0.9, 0.7], 0.8455), ([0.9, 0.8, 0.7, 0.6], 0.866093), ([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3], 0.850797)])
def test_confidence(spark, scores, want):
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id long, rank int, score double")
    assert answers.confidence(df).first()["confidence"] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (800, 1), (801, 2), (1600, 2), (1601, 3), (3751, 5)])
def test_fixed_chunks(spark, n, want):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = [r.content for r in chunking.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()]
    assert len(got) == want and "".join(c[:800] for c in got)[:n] == text


def test_other_chunks(spark):
    df = spark.createDataFrame([(1, "A one. B two! C three? D"), (2, None), (3, "# H1\nx\n# H2\ntail")], "doc_id long, text string")
    s = [r.content for r in chunking.chunks(df.where("doc_id = 1"), "sentence", size=14).orderBy("chunk_index").collect()]
    assert s == ["A one. B two!", "C three? D"]
    m = [r.content for r in chunking.chunks(df.where("doc_id = 3"), "semantic").orderBy("chunk_index").collect()]
    assert m == ["# H1", "x\n# H2", "tail"]
    assert chunking.chunks(df.where("doc_id = 2")).count() == 0


def test_mmr_keeps_the_first_and_all(spark):
    df = spark.createDataFrame([(1, i, i + 1, 1 - i / 10, [float(i % 2), 1.0]) for i in range(6)], "query_id long, id long, rank int, score double, embedding array<double>")
    r = sorted(rerank.mmr(df).collect(), key=lambda x: x.new_rank)
    assert r[0].id == 0 and {x.id for x in r} == set(range(6)) and r[1].id == 1


def test_select_builder(spark):
    sql = ranking.select_sql("documents", ["id", "title"], {"status": "active"}, {"content": "search_term"}, [("created_at", False)], 10)
    assert sql == "SELECT id, title FROM documents WHERE status = 'active' AND content LIKE '%search_term%' ORDER BY created_at DESC LIMIT 10"
    with pytest.raises(ValueError):
        ranking.page(spark.range(3), 0, 10, F.col("id"))


def test_histogram(spark):
    r = g.histogram(spark.createDataFrame([(0.5,), (3.0,), (7.0,)], "v double"), "v", [1, 5, 10]).first()
    assert tuple(r) == (1, 2, 3, 10.5, 3)


def test_rate_limit(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=i)) for i in range(11)] + [(1, t0 + dt.timedelta(seconds=60)), (2, t0)]
    got = {r.user_id: (r.n, r.allowed, r.rejected, r.windows) for r in g.fixed_window(spark.createDataFrame(rows, "user_id long, ts timestamp"), 10, 60).collect()}
    assert got == {1: (12, 11, 1, 2), 2: (1, 1, 0, 1)}


def test_retention(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    none, hold = [], [(True, None)]
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), none), (2, dt.datetime(2023, 12, 27), none), (3, dt.datetime(2023, 12, 27), hold), (4, dt.datetime(2023, 12, 27), [(False, None)])], "data_id long, expires_at timestamp, holds array<struct<active:boolean,expires_at:timestamp>>")
    got = {r.data_id: (r.e, r.h) for r in df.select("data_id", g.expired(now).alias("e"), g.held(now).alias("h")).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False)}


def test_consent_and_latest(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(1, "Analytics", True, False, None), (1, "Marketing", True, True, None), (2, "Analytics", True, False, dt.datetime(2024, 1, 1))], "user_id long, purpose string, consent_given boolean, withdrawn boolean, expires_at timestamp")
    got = {(r.user_id, r.purpose): r.valid for r in g.valid_consents(df, now).collect()}
    assert got == {(1, "Analytics"): True, (1, "Marketing"): False, (2, "Analytics"): False}


def test_caches(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    df = spark.createDataFrame([(f"k{i}", 10, t[i], t[i], i, t[3 - i]) for i in range(4)], "key string, size_bytes long, created_at timestamp, last_accessed timestamp, access_count int, expires_at timestamp")
    assert {r.key for r in g.evict(df, "lru", 2).collect()} == {"k2", "k3"} == {r.key for r in g.evict(df, "lfu", 2).collect()}
    assert {r.key for r in g.evict_bytes(df, 25).collect()} == {"k2", "k3"}
    hit, miss = g.cache_split(spark.createDataFrame([("k1",), ("z",)], "key string"), df, "key")
    assert hit.count() == 1 and miss.first()["key"] == "z"


def test_vector_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, qv array<double>")
    r = [(x.query_id, x.id, x.rank) for x in vs.search(q, v, 2).orderBy("query_id", "rank").collect()]
    assert r == [(9, 1, 1), (9, 4, 2)]
    assert vs.search(q, v.limit(0), 2).count() == 0
    blocks = vs.search(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id long, qv array<double>"), v, 3, block_bytes=80)
    assert blocks.count() == 21


def test_patterns_with_what_they_need(spark):
    """Texts are redacted as by all patterns one after the other, also where one replacement comes before another's match."""
    import re

    from corpusql.functions import lexicon

    rows = ["", "no digits at all", "call 555-123-4567 or mail a.b@c.org", "123-45-6789 and 123456789", "1234 5678 9012 3456", "at 10.0.0.1 on 1.2.3", "http://x.y?key=abc", "x <script>a</script> onload = 1", "javascript:vbscript:", "123456789@a.com 1.1.1.1", "a@b.co=on1 =", "12 34 56", "ftp https://h/p&token=1.2 on=2", "x" * 30 + "=", "a@", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    for r in df.select("t", V.sanitise(F.col("t")).alias("s"), V.sensitive_hits(F.col("t")).alias("h")).collect():
        want = None
        if r.t is not None:
            want = re.sub(r"\s+", " ", r.t).strip(" ")
            for p in lexicon.SENSITIVE:
                want = re.sub(p, "[REDACTED]", want, flags=re.ASCII)
            for p in lexicon.BLOCKED:
                want = re.sub(p, "[REMOVED]", want, flags=re.ASCII)
            assert r.h == [i for i, p in enumerate(lexicon.SENSITIVE) if re.search(p, r.t, re.ASCII)]
        assert r.s == want
    # Nearly all texts skip the patterns: the needs are looked for before.
    assert set(lexicon.SENSITIVE) | set(lexicon.BLOCKED) == set(V.NEEDS)


def test_repeats_at_the_limit(spark):
    import random

    rng = random.Random(3)
    for most in (1, 2, 5, 50):
        rows = []
        for n in (0, 1, most, most + 1, 3 * most + 7):
            for times in (1, most - 1, most, most + 1, most + 2):
                w = ["k"] * times + [f"w{rng.randrange(max(n // 2, 1))}" for _ in range(n)]
                rng.shuffle(w)
                rows.append((w,))
        df = spark.createDataFrame(rows, "w array<string>")
        for r in df.select("w", V.repeats(F.col("w"), most).alias("r")).collect():
            assert r.r == any(r.w.count(x) > most for x in r.w), (most, r.w)


def test_ingest_tells_each_thing_once(spark):
    """Errors are looked for once a document, and each language's words are counted once a chunk."""
    from corpusql.functions import lexicon
    from corpusql.plans import ingest

    df = spark.createDataFrame([(1, "the end of the song and that is it"), (2, "le chat et la maison"), (3, "javascript:x of the"), (4, "x")], "doc_id long, text string").repartition(2)
    out = ingest.ingest(df, size=20, overlap=5).select("document_id", "chunk_index", "language")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    words = sum(len(v) for v in lexicon.LANGUAGES.values())
    assert plan.count("replace(lower(") == words and plan.count("too small") == 1
    assert {r.document_id for r in out.collect()} == {1, 2}
