"""Vector search, keyword scores, blends, relevance and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusql.functions import lexicon
from corpusql.functions import query_text as Q
from corpusql.functions import relevance as R
from corpusql.functions import vectors as V
from corpusql.functions.text import jaccard, terms, words
from corpusql.operators import answers, bm25, inverted_index as ii, rerank, vector_index as vi, vector_search as vs
from corpusql.plans import answer as plan
from corpusql.session import shared_path
from corpusql.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _as_of():
    return F.lit(t.AS_OF).cast("timestamp")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The stated query set of the vector searches: every vector whose number is divisible by 20.
_Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_SCORES = {
    "cosine": "1 - greatest(0, least(2, 1 - list_cosine_similarity(qv, e))) / 2",
    "euclidean": "1 / (1 + list_distance(qv, e))",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(qv, e), lambda p: abs(p[1] - p[2]))))",
    "dot": "greatest(0, least(1, list_inner_product(qv, e)))",
}


def _topk_sql(metric: str, k: int, where: str = "true", ranked: str = "true") -> str:
    return f"""WITH {_Q}, s AS (SELECT query_id, id, round({_SCORES[metric]}, 9) AS s FROM q, v WHERE {where}),
    r AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s WHERE {ranked})
    SELECT query_id, id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _asked(spark: SparkSession, base: str) -> DataFrame:
    return t.vectors(spark, base).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"), "label")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _topk(metric: str):
    def f(spark: SparkSession, base: str) -> DataFrame:
        return _rounded(vs.search(_asked(spark, base), t.vectors(spark, base), 10, metric), "score")

    f.__name__ = f"vector_topk_{metric}"
    return f


for _m in vs.METRICS:
    query(_topk_sql(_m, 10))(_topk(_m))


@query(_topk_sql("cosine", 50, ranked="s >= 0.55"))
def vector_threshold(spark, base):
    return _rounded(vs.search(_asked(spark, base), t.vectors(spark, base), 50, threshold=0.55), "score")


def _ann(spark, base):
    index = vi.build(t.vectors(spark, base), shared_path(spark, "vector-index"))
    return vi.search(index, _asked(spark, base), 10)


@query()
def vector_ann_topk(spark, base):
    """What the index finds; which neighbours it misses depends on the fit."""
    return _rounded(_ann(spark, base), "score")


@query(
    f"""WITH {_Q}, s AS (SELECT query_id, id, round({_SCORES['cosine']}, 9) AS s FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s)
    SELECT query_id, count(*) AS wanted, count(*) AS found, true AS true_scores, round(max(s), 6) AS best, true AS recall_ok FROM r WHERE rank <= 10 GROUP BY 1"""
)
def vector_ann_recall(spark, base):
    """Per query: exact neighbours, rows found, whether all their scores are true ones, the best score; and whether nine tenths of all exact neighbours are found."""
    q, v = _asked(spark, base), t.vectors(spark, base)
    # Written, as it is read three times.
    path = shared_path(spark, "vector-found")
    _ann(spark, base).write.parquet(path)
    found = spark.read.schema("query_id long, id long, score double, rank int").parquet(path)
    real = found.join(q.select("query_id", "qv"), "query_id").join(v.select("id", "embedding"), "id")
    true = F.bool_and(F.abs(F.col("score") - V.score("cosine", F.col("qv"), F.col("embedding"))) < 1e-8)
    each = real.groupBy("query_id").agg(F.count("*").alias("found"), true.alias("true_scores"), F.round(F.max("score"), 6).alias("best"))
    r = vi.recall(found, vs.search(q, v, 10)).join(each, "query_id")
    share = r.agg((F.sum("got") / F.sum("wanted")).alias("share"))
    return r.join(F.broadcast(share.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select("query_id", "wanted", "found", "true_scores", "best", (F.col("share") >= 0.9).alias("recall_ok"))


@query(_topk_sql("cosine", 5, where="id <> query_id AND label <> ql", ranked="s >= 0.4"))
def find_similar_exclude_label(spark, base):
    return _rounded(vs.find_similar(_asked(spark, base), t.vectors(spark, base), 5, threshold=0.4, unlike="label"), "score")


@query("SELECT count(*) AS points_count, count(embedding) AS vectors_count, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings")
def collection_info(spark, base):
    return vs.collection_info(t.vectors(spark, base))


@query("SELECT vec_id AS id, CAST(len(embedding) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS BOOLEAN) AS valid, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_validity(spark, base):
    return t.vectors(spark, base).select("id", V.valid(F.col("embedding")).alias("valid"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(
    f"""WITH {_Q}, s AS (SELECT query_id, id, qv, e, round({_SCORES['dot']}, 9) AS s FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s)
    SELECT query_id, id, round({_SCORES['cosine']}, 6) AS cosine, round({_SCORES['euclidean']}, 6) AS euclidean FROM r WHERE rank <= 30"""
)
def vector_pairs_jvm(spark, base):
    """Scores inside the JVM of given pairs: each query with the thirty that another metric found."""
    q, v = _asked(spark, base), t.vectors(spark, base)
    p = vs.search(q, v, 30, "dot").select("query_id", "id").join(q.select("query_id", "qv"), "query_id").join(v.select("id", "embedding"), "id")
    return p.select("query_id", "id", *[F.round(V.score(m, F.col("qv"), F.col("embedding")), 6).alias(m) for m in ("cosine", "euclidean")])


_DOCS = "docs AS (SELECT doc_id AS id, text AS content, lang, source, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS created_at, substring(text, 1, 60) AS topic, " + "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(t.SOURCE_TYPES)) + " END AS source_type FROM documents)"
_QUERIES = "qs AS (SELECT b.item_id AS query_id, b.text, e.embedding::DOUBLE[] AS qv FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"
_STOP = "[" + ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS) + "]"


def _terms_sql(x: str, stop: bool = False) -> str:
    base = rf"list_filter(list_transform(string_split_regex(lower({x}), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9_-]', '', 'g')), lambda w: w <> '')"
    return f"list_filter({base}, lambda w: NOT list_contains({_STOP}, w))" if stop else base


def _cand_sql(n: int, where: str = "true", post: str = "true") -> str:
    """Candidates of the blended search."""
    return f"""{_DOCS}, {_QUERIES},
    cs AS (SELECT query_id, e.vec_id AS id, round(1 - greatest(0, least(2, 1 - list_cosine_similarity(qv, e.embedding::DOUBLE[]))) / 2, 9) AS vs FROM qs, embeddings e WHERE {where}),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vs DESC, id) AS r FROM cs),
    c AS (SELECT query_id, docs.id, vs, r, content, lang, source, created_at, topic, source_type FROM cr JOIN docs ON docs.id = cr.id WHERE r <= {n} AND {post})"""


def _bm25_sql() -> str:
    return f"""ct AS (SELECT query_id, id, {_terms_sql('content')} AS t FROM c),
    st AS (SELECT query_id, count(*) AS n, avg(len(list_distinct(t))) AS avgdl FROM ct GROUP BY 1),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms_sql('text', True)}) AS term FROM qs) GROUP BY 1, 2),
    tf AS (SELECT query_id, id, term, len(t) AS dl, count(*) AS tf FROM (SELECT query_id, id, t, unnest(t) AS term FROM ct) GROUP BY query_id, id, term, len(t)),
    hit AS (SELECT tf.*, qtf FROM tf JOIN qt ON tf.query_id = qt.query_id AND tf.term = qt.term),
    df AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY 1, 2),
    sc AS (SELECT hit.query_id, hit.id, sum(ln((n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * qtf) AS s
           FROM hit JOIN df ON hit.query_id = df.query_id AND hit.term = df.term JOIN st ON st.query_id = hit.query_id GROUP BY 1, 2),
    b AS (SELECT c.*, coalesce(sc.s, 0) AS bm25, round(0.7 * vs + 0.3 * tanh(coalesce(sc.s, 0) / 10), 9) AS score FROM c LEFT JOIN sc ON c.query_id = sc.query_id AND c.id = sc.id),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""


def _hybrid_sql(select: str, n: int = 20, where: str = "true", post: str = "true", more: str = "") -> str:
    return f"WITH {_cand_sql(n, where, post)}, {_bm25_sql()}{more} {select}"


def _inputs(spark, base):
    return t.queries(spark, base), t.documents(spark, base), t.vectors(spark, base)


@query(
    f"""WITH d AS (SELECT doc_id AS id, {_terms_sql('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(list_distinct(t))) AS avgdl FROM d),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_terms_sql('text', True)}) AS term FROM benchmark) GROUP BY 1, 2),
    tf AS (SELECT id, term, len(t) AS dl, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) GROUP BY id, term, len(t)),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * qtf), 9) AS score FROM tf JOIN qt ON qt.term = tf.term JOIN df ON df.term = tf.term, st GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def bm25_corpus_topk(spark, base):
    """Keyword search of all documents, through an index that skips blocks."""
    docs = t.read(spark, base, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")
    index = ii.build(docs, shared_path(spark, "inverted-index"), "lang", "source")
    asked = t.read(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _rounded(ii.search(index, asked, shared_path(spark, "keyword-search")), "score")


@query(f"SELECT doc_id AS id, CAST(len({_terms_sql('text')}) AS BIGINT) AS n_terms, CAST(len(list_distinct({_terms_sql('text')})) AS BIGINT) AS n_distinct FROM documents")
def token_counts(spark, base):
    x = terms(F.col("content"))
    return t.documents(spark, base).select("id", F.size(x).cast("long").alias("n_terms"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_terms_sql('text')})) AS term FROM documents) GROUP BY 1")
def term_document_freq(spark, base):
    return bm25.document_frequency(t.documents(spark, base))


@query(f"SELECT lang AS category, count(*) AS n, round(avg(len(list_distinct({_terms_sql('text')}))), 6) AS avgdl FROM documents GROUP BY 1")
def corpus_stats(spark, base):
    return _rounded(bm25.corpus_stats(t.documents(spark, base), "category"), "avgdl")


@query(_hybrid_sql("SELECT query_id, id, round(bm25, 6) AS bm25 FROM b"))
def bm25_scores(spark, base):
    q, d, v = _inputs(spark, base)
    return _rounded(bm25.bm25(q, plan.candidates(q, d, v)).select("query_id", "id", "bm25"), "bm25")


_TOP = "SELECT query_id, id, round(vs, 6) AS vector_score, round(bm25, 6) AS bm25, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 10"


def _hybrid(spark, base, options=plan.Options(), where=None):
    h = plan.hybrid(*_inputs(spark, base), options, where)
    return _rounded(h, "vector_score", "bm25", "score").select("query_id", "id", "vector_score", "bm25", "score", "rank")


@query(_hybrid_sql(_TOP))
def hybrid_topk(spark, base):
    return _hybrid(spark, base)


@query(_hybrid_sql(_TOP, post="lang = 'en'"))
def filter_post_topk(spark, base):
    return _hybrid(spark, base, plan.Options(filter_mode="post"), vs.filters(category="en"))


@query(_hybrid_sql(_TOP, where="e.vec_id IN (SELECT id FROM docs WHERE lang = 'en')"))
def filter_pre_topk(spark, base):
    return _hybrid(spark, base, plan.Options(filter_mode="pre"), vs.filters(category="en"))


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE (source IN ('src1', 'src2') OR lang IN ('src1', 'src2')) AND length(content) BETWEEN 500 AND 5000 AND created_at >= TIMESTAMP '2024-02-01' AND lang = 'en'")
def tag_any_filter(spark, base):
    import datetime as dt

    return t.documents(spark, base).where(vs.filters(tags=["src1", "src2"], length=(500, 5000), created_after=dt.datetime(2024, 2, 1), metadata={"lang": "en"})).select("id")


@query(
    "WITH "
    + _cand_sql(20)
    + rf""", j AS (SELECT c.query_id, c.id, list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> '') AS w, {_terms_sql('qs.text', True)} AS q FROM c JOIN qs ON qs.query_id = c.query_id),
    k AS (SELECT query_id, id, len(w) AS n, len(q) AS m, list_transform(q, lambda x: len(list_filter(w, lambda y: y = x))) AS c FROM j)
    SELECT query_id, id, round(CASE WHEN n = 0 OR m = 0 THEN 0 ELSE least(1, list_sum(c) / n / m * (1 + len(list_filter(c, lambda x: x > 0)) / m)) END, 6) AS score FROM k"""
)
def legacy_keyword_score(spark, base):
    """The older keyword score of every candidate of every query."""
    q, d, v = _inputs(spark, base)
    c = plan.candidates(q, d, v).join(q.select("query_id", "text"), "query_id")
    return c.select("query_id", "id", F.round(bm25.legacy_keyword(F.col("text"), F.col("content")), 6).alias("score"))


@query(
    "WITH "
    + _cand_sql(10)
    + r""", w AS (SELECT query_id, id, list_distinct(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS a FROM c)
    SELECT x.query_id, x.id AS a, y.id AS b, round(CASE WHEN len(x.a) + len(y.a) = 0 THEN 0 ELSE len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a) - len(list_intersect(x.a, y.a))) END, 6) AS jaccard
    FROM w x JOIN w y ON x.query_id = y.query_id AND x.id < y.id"""
)
def jaccard_pairs(spark, base):
    """All pairs among the ten passages of each query."""
    q, d, v = _inputs(spark, base)
    w = plan.candidates(q, d, v, plan.Options(candidates=10)).select("query_id", "id", F.array_distinct(words(F.col("content"))).alias("w"))
    listed = w.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.filter("r", lambda y, j: j > i), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), F.round(jaccard(x["w"], y["w"]), 6).alias("jaccard")))))
    return listed.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.a", "p.b", "p.jaccard")


# Relevance: the analysis of the query in SQL.
def _any(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, p.replace("'", "''")) for p in phrases) + ")"


_KEYSTOP = "[" + ", ".join(f"'{w}'" for w in lexicon.KEY_TERM_STOP_WORDS) + "]"
_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
_ANALYSIS = f"""a0 AS (SELECT query_id, lower(text) AS low, len({_WORDS.format('lower(text)')}) AS n FROM qs),
    a1 AS (SELECT *, CASE WHEN low LIKE 'what is%' OR low LIKE 'define%' THEN 'Factual' WHEN low LIKE 'how to%' OR low LIKE 'how do%' THEN 'Procedural'
        WHEN contains(low, ' vs ') OR contains(low, ' versus ') OR contains(low, 'compare') THEN 'Comparative' WHEN low LIKE 'why%' OR low LIKE 'explain%' THEN 'Analytical'
        WHEN low LIKE 'find%' OR contains(low, 'document') OR contains(low, 'page') THEN 'Navigational' WHEN n <= 5 AND NOT contains(low, '?') THEN 'Conversational' ELSE 'Factual' END AS type FROM a0),
    a AS (SELECT *, CASE type WHEN 'Procedural' THEN 'ProblemSolving' WHEN 'Comparative' THEN 'Decision' WHEN 'Analytical' THEN 'Learning' ELSE CASE WHEN type = 'Factual' AND n <= 5 THEN 'Exploration' ELSE 'InformationSeeking' END END AS intent,
        CASE WHEN n BETWEEN 1 AND 3 THEN 'Simple' WHEN n BETWEEN 4 AND 7 THEN 'Moderate' WHEN n BETWEEN 8 AND 15 THEN 'Complex' ELSE 'Expert' END AS complexity,
        list_filter({_WORDS.format('low')}, lambda w: NOT list_contains({_KEYSTOP}, w) AND strlen(w) > 2) AS key_terms, {_any('low', lexicon.TEMPORAL)} AS temporal FROM a1)"""
_C = "greatest(0, least(1, {0}))"
_NW = f"len({_WORDS.format('content')})"
_INFO = " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in lexicon.INFORMATIVE)
_BOOST = " ".join(f"WHEN intent = '{k}' AND {_any('lower(content)', w)} THEN {f}" for k, (f, w) in lexicon.BOOSTS.items())
_PARTS = f"""p AS (SELECT h.*, a.type, a.intent, a.temporal, a.key_terms,
    {_C.format("vs * CASE complexity WHEN 'Moderate' THEN 1.05 WHEN 'Complex' THEN 1.1 WHEN 'Expert' THEN 1.15 ELSE 1 END * CASE type WHEN 'Factual' THEN 1.1 WHEN 'Analytical' THEN 1.05 WHEN 'Procedural' THEN 0.95 ELSE 1 END")} AS semantic,
    len(list_filter(key_terms, lambda k: contains(lower(content), k))) AS kt, len(key_terms) AS kn,
    date_diff('day', created_at, TIMESTAMP '2024-12-31') AS days,
    CASE WHEN {_NW} = 0 THEN 0.5 ELSE {_C.format(f"(206.835 - 1.015 * {_NW} / len(string_split(content, '.'))) / 100")} END AS readability,
    CASE WHEN {_NW} <= 20 THEN 0.3 WHEN {_NW} <= 50 THEN 0.6 WHEN {_NW} <= 200 THEN 1.0 WHEN {_NW} <= 500 THEN 0.9 ELSE 0.7 END AS completeness,
    {_C.format("0.5 + CASE WHEN contains(content, chr(10)) THEN 0.1 ELSE 0 END + CASE WHEN contains(content, '- ') OR contains(content, '* ') THEN 0.1 ELSE 0 END + CASE WHEN contains(content, '#') THEN 0.1 ELSE 0 END + CASE WHEN length(content) - length(replace(content, ':', '')) > 2 THEN 0.1 ELSE 0 END")} AS structure,
    CASE WHEN {_NW} = 0 THEN 0 ELSE {_C.format(f"len(list_distinct({_WORDS.format('content')})) / {_NW} + ({_INFO}) / 10.0")} END AS depth,
    CASE {_BOOST} ELSE 1.0 END AS boost FROM h JOIN a ON h.query_id = a.query_id),
    r AS (SELECT *, {_C.format("tanh(bm25 / 10) * CASE WHEN kt > 0 THEN 1 + 0.2 * kt / kn ELSE 1 END * CASE type WHEN 'Procedural' THEN 1.2 WHEN 'Navigational' THEN 1.25 WHEN 'Comparative' THEN 1.1 ELSE 1 END")} AS keyword,
    readability * 0.2 + completeness * 0.3 + 0.15 + structure * 0.1 + depth * 0.1 AS quality,
    {_C.format("exp(-days / 365.0) * CASE WHEN temporal THEN 0.8 * CASE WHEN days <= 30 THEN 1.2 ELSE 1 END ELSE 1 END")} AS freshness,
    {_C.format("0.5 + CASE WHEN topic IS NULL THEN 0 WHEN len(list_filter(key_terms, lambda k: contains(lower(topic), lower(k)))) > 0 THEN 0.24 ELSE 0.06 END + CASE WHEN source_type IS NULL THEN 0 WHEN intent = 'Learning' AND source_type IN ('tutorial', 'guide') OR intent = 'ProblemSolving' AND source_type IN ('solution', 'troubleshooting') OR intent = 'InformationSeeking' AND source_type IN ('reference', 'documentation') THEN 0.18 ELSE 0.1 END")} AS context FROM p)"""


def _overall(w: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"{x} * {c}" for x, c in zip(w, ("semantic", "keyword", "quality", "freshness", "context"))) + ") * boost"


def _relevance_sql(select: str, n: int = 20) -> str:
    return _hybrid_sql(select, n, more=f", {_ANALYSIS}, {_PARTS}")


def _ranked(spark, base):
    q, d, v = _inputs(spark, base)
    return q, plan.relevance(q, plan.hybrid(q, d, v), _as_of())


@query(f"WITH {_QUERIES}, {_ANALYSIS} SELECT query_id, type, intent, complexity, temporal, array_to_string(key_terms, ' ') AS key_terms FROM a")
def query_analyze(spark, base):
    a = Q.analysis(F.col("text"))
    r = t.queries(spark, base).select("query_id", a.alias("a"))
    return r.select("query_id", "a.type", "a.intent", "a.complexity", "a.temporal", F.array_join("a.key_terms", " ").alias("key_terms"))


@query(_relevance_sql("SELECT query_id, id, " + ", ".join(f"CAST(round({c}, 6) AS DOUBLE) AS {c}" for c in ("semantic", "keyword", "quality", "freshness", "context", "boost")) + f", round({_overall(lexicon.PRESETS['general'])}, 6) AS overall FROM r WHERE rank <= 10"))
def relevance_components(spark, base):
    _, r = _ranked(spark, base)
    names = ("semantic", "keyword", "quality", "freshness", "context", "boost", "overall")
    return r.select("query_id", "id", *[F.round(c, 6).alias(c) for c in names])


@query(_relevance_sql(" UNION ALL ".join(f"SELECT query_id, id, '{k}' AS preset, round({_overall(w)}, 6) AS overall FROM r WHERE rank <= 10" for k, w in lexicon.PRESETS.items())))
def relevance_presets(spark, base):
    _, r = _ranked(spark, base)
    five = [F.col(c) for c in ("semantic", "keyword", "quality", "freshness", "context")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("preset"), F.round(R.overall(*five, F.col("boost"), w), 6).alias("overall")) for k, w in lexicon.PRESETS.items()]))
    return r.select("query_id", "id", each.alias("e")).select("query_id", "id", "e.preset", "e.overall")


@query(
    _relevance_sql(
        f""", o AS (SELECT query_id, id, round({_overall(lexicon.PRESETS['general'])}, 9) AS score FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o WHERE score >= 0.3)
        SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""",
        50,
    )
)
def enhanced_retrieval(spark, base):
    e = plan.enhanced(*_inputs(spark, base), _as_of())
    return e.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_QUERIES}, {_ANALYSIS} SELECT query_id, CASE WHEN type IN ('Procedural', 'Navigational') THEN 'Keyword' WHEN intent = 'Learning' THEN 'Quality' WHEN temporal THEN 'Fresh' WHEN type = 'Analytical' THEN 'Semantic' ELSE 'Balanced' END AS strategy FROM a")
def retrieval_strategy(spark, base):
    return t.queries(spark, base).select("query_id", Q.strategy(Q.analysis(F.col("text"))).alias("strategy"))


# Reranking of the ten best of the blended search.
_RQ = f"""greatest(0, least(1, 0.5 + CASE WHEN strlen(content) >= 100 THEN 0.2 ELSE -0.2 END + CASE WHEN {_NW} > 10 AND len(string_split(content, '.')) > 1 THEN 0.2 ELSE 0 END
    + CASE WHEN contains(content, chr(10)) OR contains(content, '- ') OR contains(content, '1. ') THEN 0.1 ELSE 0 END))"""
_RC = "CASE WHEN date_diff('day', created_at, TIMESTAMP '2024-12-31') <= 7 THEN 1.1 ELSE greatest(pow(0.999, date_diff('day', created_at, TIMESTAMP '2024-12-31')), 0.1) END"
_FINAL = "SELECT query_id, id, round(f, 6) AS final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, id) AS INTEGER) AS new_rank FROM f"


def _final(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("final_score", 6).alias("final_score"), "new_rank")


def _best(spark, base):
    return plan.hybrid(*_inputs(spark, base))


@query(_hybrid_sql(f", z AS (SELECT *, {_RQ} AS q FROM h WHERE rank <= 10), f AS (SELECT query_id, id, score * CASE WHEN round(q, 9) > 0.7 THEN 1.2 WHEN round(q, 9) < 0.3 THEN 0.8 ELSE 1 END + 0.15 * q AS f FROM z) {_FINAL}"))
def rerank_quality(spark, base):
    return _final(rerank.rerank(_best(spark, base), "Quality"))


@query(_hybrid_sql(f", f AS (SELECT query_id, id, score + 0.1 * ({_RC}) AS f FROM h WHERE rank <= 10) {_FINAL}"))
def rerank_temporal(spark, base):
    return _final(rerank.rerank(_best(spark, base), "Temporal", as_of=_as_of()))


_DIV = rf"""z AS (SELECT *, list_distinct({_WORDS.format('content')}) AS w FROM h WHERE rank <= 10),
    m AS (SELECT x.query_id, x.rank, min(CASE WHEN len(x.w) + len(y.w) = 0 THEN 0 ELSE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) END) AS l FROM z x JOIN z y ON x.query_id = y.query_id AND y.rank < x.rank GROUP BY 1, 2),
    d AS (SELECT z.*, CASE WHEN l IS NULL THEN 1 ELSE (1 - l) * CASE WHEN l > 0.85 THEN 0.5 ELSE 1 END END AS d FROM z LEFT JOIN m ON z.query_id = m.query_id AND z.rank = m.rank)"""


@query(_hybrid_sql(f", {_DIV}, f AS (SELECT query_id, id, score + 0.2 * d AS f FROM d) {_FINAL}"))
def rerank_diversity(spark, base):
    return _final(rerank.rerank(_best(spark, base), "Diversity"))


def _adaptive(i: int, shift: float) -> str:
    return "(CASE type " + " ".join(f"WHEN '{k}' THEN {w[i]}" for k, w in lexicon.ADAPTIVE.items()) + f" END + CASE WHEN temporal THEN {shift} ELSE 0 END)"


@query(
    _hybrid_sql(
        f"""SELECT query_id, id, round(f, 6) AS final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, id) AS INTEGER) AS new_rank FROM f""",
        more=f""", {_ANALYSIS}, {_DIV}, g AS (SELECT d.*, {_RQ} AS q, {_RC} AS c, {_adaptive(0, -0.1)} AS wq, {_adaptive(1, -0.1)} AS wd, {_adaptive(2, 0.2)} AS wr FROM d JOIN a ON a.query_id = d.query_id),
        f AS (SELECT query_id, id, 0.3 * score + (wq * q + wr * c + wd * d) / greatest(1, wq + wd + wr) AS f FROM g)""",
    )
)
def rerank_hybrid(spark, base):
    q, _, _ = _inputs(spark, base)
    best = _best(spark, base).join(q.select("query_id", Q.analysis(F.col("text")).alias("analysis")), "query_id")
    return _final(rerank.rerank(best, "Hybrid", as_of=_as_of()))


@query(_hybrid_sql(f", {_DIV}, f AS (SELECT query_id, id, rank, score + 0.2 * d AS f FROM d), n AS (SELECT rank, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, id) AS new_rank FROM f) SELECT CAST(new_rank - rank AS BIGINT) AS rank_change, count(*) AS n FROM n GROUP BY 1"))
def rank_changes(spark, base):
    return rerank.rank_changes(rerank.diversity(_best(spark, base)))


@query(
    _hybrid_sql(
        """, z AS (SELECT h.*, e.embedding::DOUBLE[] AS e FROM h JOIN embeddings e ON e.vec_id = h.id WHERE rank <= 10),
        m AS (SELECT x.query_id, x.rank, max(list_cosine_similarity(x.e, y.e)) AS m FROM z x JOIN z y ON x.query_id = y.query_id AND y.rank < x.rank GROUP BY 1, 2),
        f AS (SELECT z.query_id, z.id, score - 0.3 * coalesce(m, 0) AS f FROM z LEFT JOIN m ON z.query_id = m.query_id AND z.rank = m.rank) """
        + _FINAL
    )
)
def diversity_penalty(spark, base):
    q, d, v = _inputs(spark, base)
    return _final(rerank.diversity_penalty(plan.hybrid(q, d, v).join(v.select("id", "embedding"), "id")))


@query(
    "WITH RECURSIVE "
    + _cand_sql(20)
    + ", "
    + _bm25_sql()
    + """, z AS (SELECT h.query_id, h.id, h.rank, score, e.embedding::DOUBLE[] AS e FROM h JOIN embeddings e ON e.vec_id = h.id WHERE rank <= 10),
    l AS (SELECT x.query_id, x.rank AS a, y.rank AS b, greatest(0, least(1, list_cosine_similarity(x.e, y.e))) AS l FROM z x JOIN z y ON x.query_id = y.query_id),
    s AS (SELECT query_id, 1 AS step, [rank] AS chosen FROM z WHERE rank = 1
    UNION ALL SELECT query_id, step + 1, list_append(chosen, best) FROM (
      SELECT query_id, step, chosen, arg_max(rank, (round(v, 12), -rank)) AS best FROM (
        SELECT s.query_id, s.step, s.chosen, z.rank, 0.5 * z.score - 0.5 * max(l.l) AS v FROM s JOIN z ON z.query_id = s.query_id AND NOT list_contains(s.chosen, z.rank) JOIN l ON l.query_id = s.query_id AND l.a = z.rank AND list_contains(s.chosen, l.b)
        GROUP BY s.query_id, s.step, s.chosen, z.rank, z.score) GROUP BY query_id, step, chosen)),
    f AS (SELECT query_id, arg_max(chosen, step) AS chosen FROM s GROUP BY 1)
    SELECT z.query_id, z.id, CAST(list_position(chosen, z.rank) AS BIGINT) AS new_rank FROM z JOIN f ON f.query_id = z.query_id"""
)
def mmr(spark, base):
    q, d, v = _inputs(spark, base)
    return rerank.mmr(plan.hybrid(q, d, v).join(v.select("id", "embedding"), "id"))


_CONF = """, z AS (SELECT query_id, rank, score FROM h WHERE rank <= 10),
    g AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, max(score) FILTER (rank = 3) AS s3, avg(score) FILTER (rank <= 5) AS m, stddev_pop(score) FILTER (rank <= 5) AS d FROM z GROUP BY 1),
    cf AS (SELECT query_id, n AS n_chunks, round(greatest(0, least(1, 0.7 * CASE n WHEN 1 THEN s1 WHEN 2 THEN s1 * 0.7 + s2 * 0.3 ELSE s1 * 0.5 + s2 * 0.3 + s3 * 0.2 END
        + 0.2 * CASE WHEN n = 1 THEN 0.7 WHEN n <= 3 THEN 0.85 WHEN n <= 6 THEN 1 ELSE 0.95 END + 0.1 * CASE WHEN n = 1 THEN 0.8 ELSE greatest(0.5, 1 - least(1, d / m)) END)), 6) AS confidence FROM g)"""


@query(_hybrid_sql(_CONF + " SELECT query_id, n_chunks, confidence FROM cf"))
def answer_confidence(spark, base):
    return _rounded(answers.confidence(_best(spark, base)), "confidence")


@query(_hybrid_sql("SELECT query_id, string_agg('[' || rank || '] ' || content || chr(10) || chr(10), '' ORDER BY rank) AS context FROM h WHERE rank <= 10 GROUP BY 1"))
def context_assembly(spark, base):
    return answers.context(_best(spark, base))


@query(_hybrid_sql("SELECT query_id, id, id AS document_id, trim(substring(content, 1, 200)) || CASE WHEN strlen(content) > 200 THEN '...' ELSE '' END AS excerpt, round(score, 6) AS score FROM h WHERE rank <= 10"))
def citations(spark, base):
    return _rounded(answers.citations(_best(spark, base)), "score")


@query(
    _hybrid_sql(
        _CONF
        + """ SELECT qs.query_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(confidence, 0) AS confidence,
        CASE WHEN contains(lower(text), 'what is') THEN 'The passages cited define it.' WHEN contains(lower(text), 'how to') THEN 'The passages cited give the steps.' ELSE 'See the passages cited.' END AS answer FROM qs LEFT JOIN cf ON qs.query_id = cf.query_id"""
    )
)
def answer_batch(spark, base):
    """The flagship: every stage of answering a batch of queries."""
    return _rounded(plan.answer(*_inputs(spark, base)), "confidence").select("query_id", "n_chunks", "confidence", "answer")


@query(
    _relevance_sql(
        f", o AS (SELECT query_id, id, rank, round({_overall(lexicon.PRESETS['general'])}, 6) AS s, semantic, keyword, quality, freshness, context FROM r WHERE rank <= 10), g AS (SELECT *, (semantic + keyword + quality + freshness + context) / 5 AS m FROM o) SELECT query_id, id, round(greatest(0, least(1, 1 - sqrt(((semantic - m) ** 2 + (keyword - m) ** 2 + (quality - m) ** 2 + (freshness - m) ** 2 + (context - m) ** 2) / 5))), 6) AS confidence, (round(semantic, 9) > 0.7) AS semantic_good, (round(keyword, 9) < 0.2) AS keyword_bad FROM g"
    )
)
def score_explanation(spark, base):
    _, r = _ranked(spark, base)
    s = R.signals(F.col("semantic"), F.col("keyword"), F.col("quality"), F.col("boost"))
    return r.select("query_id", "id", F.round("confidence", 6).alias("confidence"), F.array_contains(s["positive"], "high semantic similarity").alias("semantic_good"), F.array_contains(s["negative"], "weak keyword match").alias("keyword_bad"))
