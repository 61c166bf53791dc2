"""Embeddings, listings, privacy duties, keys, metrics and metadata records, over the test tables."""

from __future__ import annotations

import datetime as dt
import string

from pyspark.sql import functions as F

from corpusql import sqlfunctions
from corpusql.catalogue import governance as G
from corpusql.catalogue import search as S
from corpusql.catalogue import text as X
from corpusql.functions import crypto, lexicon
from corpusql.functions import query_text as Q
from corpusql.functions import relevance as R
from corpusql.functions import text as T
from corpusql.functions import validation as V
from corpusql.functions import vectors as VE
from corpusql.operators import caching, compliance as c
from corpusql.operators import embedding as e
from corpusql.operators import governance as g
from corpusql.operators import answers, bm25, chunking, ranking, records, rerank, retention_log, vector_search as vs
from corpusql.plans import answer as plan, ingest
from corpusql.session import shared_path
from corpusql.sources import tables as t
from corpusql.streaming import batcher, events as st

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Embeddings.
_BYTES = "list_transform(range(0, strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"
_HASH = "list_reduce(list_prepend(0::BIGINT, " + _BYTES + "), lambda a, b: (31 * a + b) % 4294967296)"
_TOY = "[strlen({0}) / 100, CAST(list_sum(list_transform(list_filter(string_split({0}, ''), lambda x: x <> ''), lambda x: unicode(x))) AS DOUBLE) / 10000, 0.5, -0.2, 0.8]::DOUBLE[]"
_PREPROCESSED = r"trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9\s.,!?-]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT item_id, 'local' AS provider, round(((h + 0) / 4294967296 - 0.5) * 0.2, 9) AS first, round(((h + 7) / 4294967296 - 0.5) * 0.2, 9) AS last FROM (SELECT item_id, {_HASH.format('text')} AS h FROM benchmark)")
def embed_texts(spark, base):
    """The local stand-in provider over the benchmark's texts."""
    b = e.embedded(t.read(spark, base, "benchmark").select("item_id", "text"), "text", [e.local(dimension=8, max_bytes=1 << 20)])
    return b.select("item_id", "provider", F.round(F.col("embedding")[0], 9).alias("first"), F.round(F.col("embedding")[7], 9).alias("last"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN strlen(text) > 8192 THEN strlen(text) || ' bytes, at most 8192' END AS issue FROM documents")
def embedding_limits(spark, base):
    return t.read(spark, base, "documents").select("doc_id", e.limit_issue(F.col("text"), e.Provider("x", 1, e.toy)).alias("issue"))


@query(f"SELECT doc_id, list_transform({_TOY.format('text')}, lambda x: round(x, 6)) AS embedding FROM documents WHERE text <> ''")
def toy_embedding(spark, base):
    """The arithmetic stand-in as an expression inside the JVM."""
    d = t.read(spark, base, "documents").where("text <> ''")
    return d.select("doc_id", F.transform(VE.toy_embedding(F.col("text")), lambda x: F.round(x, 6)).alias("embedding"))


@query(
    f"""WITH q AS (SELECT item_id AS query_id, {_TOY.format('p')} AS qv FROM (SELECT item_id, {_PREPROCESSED} AS p FROM benchmark) WHERE p <> ''),
    d AS (SELECT doc_id AS id, {_TOY.format('text')} AS e FROM documents WHERE trim(text) <> ''),
    s AS (SELECT query_id, id, round(1 / (1 + list_distance(qv, e)), 9) AS s FROM q, d),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s)
    SELECT query_id, id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def search_by_text(spark, base):
    """From query texts: cleaned, embedded by a provider, searched among documents that it embedded."""
    q = t.read(spark, base, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = t.documents(spark, base).select("id", "content")
    return e.search_text(q, d, [e.TOY], 10, metric="euclidean").withColumn("score", F.round("score", 6))


# A cache of embeddings of two thirds of the documents, part of it over.
_EC = """c AS (SELECT sha256('toy:1:' || text) AS key, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)) AS expires_at, count(*) AS access_count FROM (SELECT text, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY text) WHERE doc_id % 3 > 0 GROUP BY 1, 2)"""
_ED = "d AS (SELECT doc_id, sha256('toy:1:' || text) AS key FROM documents WHERE trim(text) <> '')"
_EDS = f"{_EC}, {_ED}, s AS (SELECT doc_id, d.key, CASE WHEN c.key IS NULL THEN 'miss' WHEN TIMESTAMP '2024-01-15' > expires_at THEN 'expired' ELSE 'hit' END AS status FROM d LEFT JOIN c ON c.key = d.key)"


def _kept(spark, base):
    d = t.read(spark, base, "documents").where("trim(text) <> ''")
    d = d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).where("doc_id % 3 > 0")
    until = F.timestamp_add("DAY", F.pmod("doc_id", F.lit(40)).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    made = F.lit("2023-12-25 00:00:00").cast("timestamp")
    v = VE.toy_embedding(F.col("text"))
    return d.select(e.cache_key("toy", "1", F.col("text")).alias("key"), v.alias("embedding"), e.entry_bytes(v).alias("size_bytes"), made.alias("created_at"), made.alias("last_accessed"), F.lit(1).cast("long").alias("access_count"), until.alias("expires_at"))


def _looked_up(spark, base):
    d = t.read(spark, base, "documents").where("trim(text) <> ''").select("doc_id", "text")
    return e.get_or_compute(d, _kept(spark, base), "text", [e.TOY], F.lit("2024-01-15 00:00:00").cast("timestamp"), model="toy")


@query(f"WITH {_EDS} SELECT doc_id, key, status, 5 AS dimension FROM s")
def embedding_cache_lookup(spark, base):
    found, _ = _looked_up(spark, base)
    return found.select("doc_id", "key", "status", F.size("embedding").alias("dimension"))


@query(
    f"""WITH {_EDS}, n AS (SELECT key, status, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT key, 84 AS size_bytes, n + CASE WHEN status = 'hit' THEN 1 ELSE 0 END AS access_count, CASE WHEN status = 'hit' THEN TIMESTAMP '2023-12-25' ELSE TIMESTAMP '2024-01-15' END AS created_at, TIMESTAMP '2024-01-15' AS last_accessed FROM n"""
)
def embedding_cache_after(spark, base):
    """The cache after a batch of look-ups: entries used, renewed and added."""
    _, after = _looked_up(spark, base)
    return after.select("key", "size_bytes", "access_count", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("last_accessed").cast("timestamp_ntz").alias("last_accessed"))


@query(f"WITH {G._CACHE} SELECT key, access_count FROM c WHERE NOT TIMESTAMP '2024-02-01' > created_at + to_days(30) ORDER BY access_count DESC, key LIMIT 150")
def cache_maintenance(spark, base):
    return e.maintained(G._cache(spark, base), G._as_of(), 150).select("key", "access_count")


@query(f"WITH {G._CACHE} SELECT key FROM c ORDER BY created_at DESC, key LIMIT 120")
def cache_evict_fifo(spark, base):
    return g.evict(G._cache(spark, base), "fifo", 120).select("key")


@query(f"WITH {G._CACHE} SELECT key FROM c ORDER BY created_at + to_days(30) DESC, key LIMIT 80")
def cache_evict_ttl(spark, base):
    return g.evict(G._cache(spark, base), "ttl", 80).select("key")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'expected 64 values, found 63' END AS issue, round(list_sum(CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding::DOUBLE[] END), 6) AS total FROM embeddings")
def vector_dimensions(spark, base):
    """Vectors of a wrong size are named and left out of the sum."""
    v = t.vectors(spark, base).withColumn("embedding", F.when(F.col("id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return v.select("id", VE.size_issue(F.col("embedding"), 64).alias("issue"), F.round(VE.total(VE.doubles(VE.of_size(F.col("embedding"), 64))), 6).alias("total"))


_LEVELS = "k AS (SELECT DISTINCT user_id AS key FROM events), n AS (SELECT user_id AS key, max(event_type) AS value FROM events WHERE user_id % 5 = 0 GROUP BY 1), f AS (SELECT user_id AS key, min(event_type) AS value FROM events WHERE user_id % 3 = 0 GROUP BY 1)"


def _levels(spark, base):
    ev = G._events(spark, base)
    until = F.lit("2024-03-01 00:00:00").cast("timestamp")
    near = ev.where("user_id % 5 = 0").groupBy(F.col("user_id").alias("key")).agg(F.max("event_type").alias("value")).withColumn("expires_at", until)
    far = ev.where("user_id % 3 = 0").groupBy(F.col("user_id").alias("key")).agg(F.min("event_type").alias("value")).withColumn("expires_at", F.when(F.col("key") % 2 == 0, until).otherwise(F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return caching.look_up(ev.select(F.col("user_id").alias("key")).distinct(), near, far, G._as_of())


@query(f"WITH {_LEVELS} SELECT k.key, coalesce(n.value, f.value) AS value, CASE WHEN n.value IS NOT NULL THEN 'near' WHEN f.value IS NOT NULL THEN 'far' END AS level FROM k LEFT JOIN n ON n.key = k.key LEFT JOIN (SELECT * FROM f WHERE key % 2 = 0) f ON f.key = k.key")
def two_level_lookup(spark, base):
    """Young entries before old ones; what is over counts for nothing."""
    return _levels(spark, base).select("key", "value", "level")


@query(f"WITH {_LEVELS} SELECT key, strlen(value) AS size_bytes, TIMESTAMP '2024-02-01 00:05:00' AS expires_at FROM f WHERE key % 2 = 0 AND key NOT IN (SELECT key FROM n)")
def two_level_promotion(spark, base):
    p = caching.promoted(_levels(spark, base), G._as_of(), 3600)
    return p.select("key", "size_bytes", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


# Records: reading, listing, changing.
@query("SELECT doc_id AS id, lang AS category, substring(text, 1, 20) AS head FROM documents WHERE doc_id IN (3, 17, 999999999, 4)")
def lookup_by_id(spark, base):
    return records.by_id(t.documents(spark, base), "id", [3, 17, 999999999, 4]).select("id", "category", F.substring("content", 1, 20).alias("head"))


@query("SELECT doc_id AS id, lang AS category FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND source <> 'src0' ORDER BY doc_id LIMIT 20 OFFSET 10")
def document_list(spark, base):
    d = t.read(spark, base, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("category"), "source")
    return records.listed(d.where("source <> 'src0'"), F.col("id"), text="the", equal={"category": "en"}, limit=20, offset=10).select("id", "category")


@query("SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE doc_id >= 100")
def batch_delete(spark, base):
    return records.batch_delete(t.read(spark, base, "documents"), "doc_id", list(range(100))).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE lang END AS lang, CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2024-12-31' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM documents")
def update_with_time(spark, base):
    """Changed rows carry the time of the change; of several changes of a key the latest counts."""
    old = t.read(spark, base, "documents").select("doc_id", "lang", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    tens = old.where("doc_id % 10 = 0").select("doc_id")
    new = tens.select("doc_id", F.lit("older").alias("lang"), F.lit(1).alias("o")).union(tens.select("doc_id", F.lit("new"), F.lit(2)))
    out = t.upsert(old, records.stamped(new, F.lit(t.AS_OF).cast("timestamp")), "doc_id", order="o")
    return out.select("doc_id", "lang", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("SELECT event_id FROM events WHERE user_id BETWEEN 10 AND 60 AND event_type = 'purchase' AND value >= 50 AND value <= 200 ORDER BY ts DESC, event_id LIMIT 100")
def history_filter(spark, base):
    log = G._events(spark, base).select("event_id", F.col("user_id"), F.col("event_type").alias("model"), F.col("value").alias("processing_time"), "ts")
    return records.history(log.where("user_id BETWEEN 10 AND 60"), model="purchase", time=(50, 200), limit=100).select("event_id")


@query(
    """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'text: empty' END, CASE WHEN strlen(text) > 10000 THEN 'text: too long' END,
    CASE WHEN turn * 0.3 > 1 THEN 'threshold: from 0 to 1' END, CASE WHEN turn * 20 NOT BETWEEN 1 AND 50 THEN 'max_chunks: from 1 to 50' END], lambda x: x IS NOT NULL), ',') AS issues FROM conversations"""
)
def request_validation(spark, base):
    r = t.read(spark, base, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 0.3).alias("threshold"), (F.col("turn") * 20).alias("max_chunks"))
    return r.select("conv_id", "turn", F.array_join(records.request_issues(F.col("text"), F.col("threshold"), F.col("max_chunks")), ",").alias("issues"))


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'TXT' WHEN 2 THEN 'md' WHEN 3 THEN 'exe' ELSE '' END"


@query(
    f"""WITH u AS (SELECT doc_id, {_KIND} AS ext, strlen(text) * 20000 AS size FROM documents)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN ext = '' THEN 'no extension' WHEN ext = 'exe' THEN 'extension exe' END, CASE WHEN size = 0 THEN 'empty' END, CASE WHEN size > 52428800 THEN 'too large' END, CASE WHEN doc_id % 6 = 0 THEN 'metadata: not JSON' END, CASE WHEN doc_id % 9 = 0 THEN 'strategy' END], lambda x: x IS NOT NULL), ',') AS issues,
    CASE ext WHEN 'pdf' THEN 'application/pdf' WHEN 'TXT' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime, doc_id || '.' || CASE ext WHEN '' THEN 'bin' ELSE ext END AS name FROM u"""
)
def upload_gate(spark, base):
    d = t.read(spark, base, "documents")
    ext = F.expr(_KIND)
    d = d.select("doc_id", F.concat(F.lit("/in/a file"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias("path"), (F.octet_length("text") * F.lit(20000).cast("long")).alias("length"), F.when(F.col("doc_id") % 6 == 0, "{not").otherwise('{"a": 1}').alias("metadata"), F.when(F.col("doc_id") % 9 == 0, "clever").otherwise("fixed_size").alias("strategy"))
    p = F.col("path")
    return d.select("doc_id", F.array_join(records.upload_issues(p, F.col("length"), F.col("metadata"), F.col("strategy")), ",").alias("issues"), T.mime(p).alias("mime"), T.safe_name(p, F.col("doc_id").cast("string")).alias("name"))


@query(
    f"""WITH d AS (SELECT doc_id % 7 AS batch, trim(text) <> '' AND strlen(text) BETWEEN 10 AND 10485760 AND NOT ({' OR '.join(f'regexp_matches(text, {X._lit(p)})' for p in lexicon.BLOCKED)}) AS ok FROM documents)
    SELECT batch, count(*) AS files, count(*) FILTER (ok) AS done, count(*) FILTER (NOT ok) AS failed FROM d GROUP BY 1"""
)
def batch_upload(spark, base):
    """Batches of files in which one bad file doesn't stop the others."""
    d = t.read(spark, base, "documents").select(F.pmod("doc_id", F.lit(7)).alias("batch"), "doc_id", "text")
    return ingest.batch_jobs(d, "batch")


@query("SELECT document_id, count(*) AS chunks, count(*) FILTER (length(content) >= 100) AS embedded FROM (SELECT doc_id AS document_id, substring(text, i * 800 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM documents)) GROUP BY 1")
def ingest_progress(spark, base):
    """Chunks of each document, and those that have a vector (here, those of a hundred characters)."""
    d = chunking.chunks(t.read(spark, base, "documents").select("doc_id", "text"), "fixed")
    return ingest.progress(d.withColumn("embedding", F.when(F.length("content") >= 100, F.array(F.lit(1.0)))))


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({S._terms_sql('text')}) AS term FROM documents) GROUP BY 1, 2")
def chunk_term_counts(spark, base):
    return bm25.chunk_terms(t.documents(spark, base), ["id"])


@query(S._hybrid_sql("SELECT x.query_id, 'Context:' || chr(10) || context || 'Question: ' || qs.text || chr(10) || 'Answer:' AS prompt FROM (SELECT query_id, string_agg('[' || rank || '] ' || content || chr(10) || chr(10), '' ORDER BY rank) AS context FROM h WHERE rank <= 10 GROUP BY 1) x JOIN qs ON qs.query_id = x.query_id"))
def prompt_assembly(spark, base):
    q, _, _ = S._inputs(spark, base)
    x = answers.context(S._best(spark, base)).join(q.select("query_id", "text"), "query_id")
    return x.select("query_id", answers.prompt(F.col("text"), F.col("context")).alias("prompt"))


# Privacy duties, over events and orders.
_PROC = "p AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ServiceProvision' WHEN '2-HIGH' THEN 'AccountManagement' ELSE 'Analytics' END AS purpose, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Contract' END AS lawful_basis, o_custkey % 150 AS user_id, o_orderstatus AS activity, o_orderdate AS ts FROM orders)"
_CONS = "cs AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'Analytics' WHEN 'view' THEN 'Marketing' ELSE 'ServiceProvision' END AS purpose, value > 20 AS consent_given, event_type = 'error' AS withdrawn, ts, CASE WHEN event_type IN ('click', 'view') THEN ts + to_days(365) END AS expires_at, event_id FROM events)"
_REQ = "rq AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Submitted' WHEN event_id % 3 = 1 THEN 'UnderReview' ELSE 'Completed' END AS status, event_id % 3 = 2 AS fulfilled, ts + to_days(30) AS deadline FROM events WHERE event_type = 'signup')"
_BR = "br AS (SELECT event_id, CASE WHEN value > 400 THEN 'Critical' WHEN value > 300 THEN 'High' WHEN value > 200 THEN 'Medium' ELSE 'Info' END AS severity, event_id % 2 = 0 AS authority_notified FROM events WHERE event_type = 'error')"
_AT = "TIMESTAMP '2025-01-15'"


def _at():
    return F.lit("2025-01-15 00:00:00").cast("timestamp")


def _processing(spark, base):
    o = t.read(spark, base, "orders")
    p = F.col("o_orderpriority")
    purpose = F.when(p == "1-URGENT", "ServiceProvision").when(p == "2-HIGH", "AccountManagement").otherwise("Analytics")
    return o.select(F.col("o_orderkey").alias("id"), purpose.alias("purpose"), F.when(F.col("o_orderstatus") == "P", "").otherwise("Contract").alias("lawful_basis"), F.pmod("o_custkey", F.lit(150)).alias("user_id"), F.col("o_orderstatus").alias("activity"), F.col("o_orderdate").cast("timestamp").alias("ts"))


def _consents(spark, base):
    ev = G._events(spark, base)
    k = F.col("event_type")
    r = ev.select("user_id", F.when(k == "click", "Analytics").when(k == "view", "Marketing").otherwise("ServiceProvision").alias("purpose"), (F.col("value") > 20).alias("consent_given"), (k == "error").alias("withdrawn"), "ts", F.struct("ts", "event_id").alias("o"))
    return c.with_expiry(r)


def _requests(spark, base):
    ev = G._events(spark, base).where("event_type = 'signup'")
    m = F.col("event_id") % 3
    return c.submitted(ev.select("event_id", F.when(m == 0, "Submitted").when(m == 1, "UnderReview").otherwise("Completed").alias("status"), (m == 2).alias("fulfilled"), F.col("ts").alias("submitted_at")))


def _breaches(spark, base):
    ev = G._events(spark, base).where("event_type = 'error'")
    v = F.col("value")
    return ev.select("event_id", F.when(v > 400, "Critical").when(v > 300, "High").when(v > 200, "Medium").otherwise("Info").alias("severity"), (F.col("event_id") % 2 == 0).alias("authority_notified"))


@query(
    f"""WITH {_PROC}, {_CONS}, {_REQ}, {_BR}, o AS (SELECT (SELECT count(*) FROM p) AS activities, (SELECT count(*) FILTER (lawful_basis = '') FROM p) AS no_basis,
    (SELECT count(*) FILTER (consent_given AND NOT withdrawn AND (expires_at IS NULL OR expires_at > {_AT})) FROM cs) AS active_consents,
    (SELECT count(*) FILTER (status IN ('Submitted', 'UnderReview')) FROM rq) AS pending_requests, (SELECT count(*) FILTER (NOT fulfilled AND deadline < {_AT}) FROM rq) AS overdue_requests,
    (SELECT count(*) FROM br) AS breaches, (SELECT count(*) FILTER (severity IN ('High', 'Critical')) FROM br) AS high_risk_breaches, (SELECT count(*) FILTER (severity IN ('Medium', 'High', 'Critical') AND NOT authority_notified) FROM br) AS unnotified)
    SELECT *, CASE CAST(overdue_requests > 0 AS INTEGER) + CAST(unnotified > 0 AS INTEGER) + CAST(no_basis > 0 AS INTEGER) WHEN 0 THEN 'Compliant' WHEN 3 THEN 'MajorIssues' ELSE 'MinorIssues' END AS status FROM o"""
)
def compliance_report(spark, base):
    return c.compliance_report(_processing(spark, base), _consents(spark, base), _requests(spark, base), _breaches(spark, base), _at())


@query(
    f"""WITH {_PROC}, {_CONS}, u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 250)
    SELECT user_id, 'consent' AS kind, purpose AS name, count(*) AS n, min(ts) AS first, max(ts) AS last, coalesce(bool_or(consent_given AND NOT withdrawn AND (expires_at IS NULL OR expires_at > {_AT})), false) AS valid FROM cs WHERE user_id IN (SELECT user_id FROM u) GROUP BY 1, 3
    UNION ALL SELECT user_id, 'processing', activity, count(*), min(ts), max(ts), NULL FROM p WHERE purpose IN ('ServiceProvision', 'AccountManagement') AND user_id IN (SELECT user_id FROM u) GROUP BY 1, 3"""
)
def access_request(spark, base):
    who = G._events(spark, base).where("event_type = 'signup' AND value > 250")
    a = c.access_request(who, _consents(spark, base), _processing(spark, base), _at())
    return a.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query(
    f"""WITH {_CONS}, l AS (SELECT user_id, purpose, arg_max({{'g': consent_given, 'w': withdrawn, 'e': expires_at, 't': ts}}, ts::VARCHAR || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS x FROM cs GROUP BY 1, 2)
    SELECT user_id, purpose, x.g AND NOT x.w AND (x.e IS NULL OR x.e > {_AT}) AS valid, x.t AS ts FROM l"""
)
def consent_log_state(spark, base):
    s = c.consent_state(_consents(spark, base).drop("expires_at"), _at())
    return s.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {_REQ} SELECT event_id, deadline FROM rq WHERE NOT fulfilled AND deadline < TIMESTAMP '2024-02-10'")
def overdue_requests(spark, base):
    r = g.overdue(_requests(spark, base), F.lit("2024-02-10 00:00:00").cast("timestamp"))
    return r.select("event_id", F.col("deadline").cast("timestamp_ntz").alias("deadline"))


@query(f"WITH {_BR} SELECT severity, severity IN ('Medium', 'High', 'Critical') AS authority, severity IN ('High', 'Critical') AS subjects, count(*) AS n FROM br GROUP BY 1")
def breach_notification(spark, base):
    b = _breaches(spark, base).withColumn("x", g.breach_notices(F.col("severity")))
    return b.groupBy("severity", F.col("x.authority").alias("authority"), F.col("x.subjects").alias("subjects")).agg(F.count("*").alias("n"))


@query(f"WITH {G._RECORDS} SELECT data_id FROM x WHERE data_type = 'Account' AND status = 'F' AND expired AND created_at >= TIMESTAMP '1993-06-01' AND expires_at <= TIMESTAMP '1999-06-01'")
def retention_query(spark, base):
    r = G._records(spark, base)
    return r.where(c.retention_filter(G._then(), data_type="Account", status="F", expired_only=True, created=(dt.datetime(1993, 6, 1), None), expires=(None, dt.datetime(1999, 6, 1)))).select("data_id")


@query(f"WITH {G._RECORDS} SELECT data_id FROM x WHERE held AND expires_at >= TIMESTAMP '1999-01-01'")
def retention_held(spark, base):
    return G._records(spark, base).where(c.retention_filter(G._then(), held_only=True, expires=(dt.datetime(1999, 1, 1), None))).select("data_id")


_ACTION = "CASE data_id % 6 WHEN 0 THEN 'hold' WHEN 1 THEN 'release' WHEN 2 THEN 'request' WHEN 3 THEN 'approve' WHEN 4 THEN 'delete' END"
_STATE = "CASE data_id % 7 WHEN 0 THEN 'DeletionRequested' WHEN 1 THEN 'DeletionApproved' WHEN 2 THEN 'Expired' ELSE 'Active' END"


@query(
    f"""WITH {G._RECORDS}, y AS (SELECT data_id, expired, held, {_STATE} AS s, {_ACTION} AS a FROM x),
    z AS (SELECT data_id, s, a, CASE WHEN a = 'hold' THEN 'LegalHold' WHEN a = 'release' AND NOT held THEN CASE WHEN expired THEN 'Expired' ELSE 'Active' END WHEN a = 'release' THEN s WHEN a = 'request' AND NOT held THEN 'DeletionRequested'
      WHEN a = 'approve' AND s = 'DeletionRequested' THEN 'DeletionApproved' WHEN a = 'delete' AND NOT held AND s IN ('DeletionApproved', 'Expired') THEN 'SoftDeleted' END AS n FROM y)
    SELECT data_id, coalesce(n, s) AS status, a IS NOT NULL AND n IS NULL AS rejected FROM z"""
)
def retention_transitions(spark, base):
    r = G._records(spark, base).withColumn("status", F.expr(_STATE))
    a = r.select("data_id", F.expr(_ACTION).alias("action")).where("action IS NOT NULL")
    return c.apply_actions(r, a, G._then()).select("data_id", "status", "rejected")


# A log of actions: every event is one, on the record of its user; the users of every tenth number have no record.
_REPLAY = """WITH RECURSIVE r AS (SELECT DISTINCT user_id AS data_id, CASE user_id % 5 WHEN 0 THEN 'DeletionRequested' WHEN 1 THEN 'Expired' WHEN 2 THEN 'DeletionApproved' ELSE 'Active' END AS status, CAST(user_id % 3 = 0 AS BIGINT) AS holds, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-02-15' END AS expires_at FROM events WHERE user_id % 10 <> 9),
    a AS (SELECT user_id AS data_id, event_id AS id, ts, CASE event_type WHEN 'signup' THEN 'hold' WHEN 'error' THEN 'release' WHEN 'view' THEN 'request' WHEN 'click' THEN 'approve' ELSE 'delete' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT r.data_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS action, status, holds, expires_at, false AS rejected FROM r
    UNION ALL SELECT s.data_id, a.i, a.id, a.action,
      CASE WHEN a.action = 'hold' THEN 'LegalHold' WHEN a.action = 'release' AND s.holds <= 1 THEN CASE WHEN a.ts > expires_at THEN 'Expired' ELSE 'Active' END WHEN a.action = 'request' AND s.holds = 0 THEN 'DeletionRequested'
        WHEN a.action = 'approve' AND s.status = 'DeletionRequested' THEN 'DeletionApproved' WHEN a.action = 'delete' AND s.holds = 0 AND s.status IN ('DeletionApproved', 'Expired') THEN 'SoftDeleted' ELSE s.status END,
      CASE WHEN a.action = 'hold' THEN s.holds + 1 WHEN a.action = 'release' THEN greatest(s.holds - 1, 0) ELSE s.holds END, expires_at,
      a.action = 'request' AND s.holds > 0 OR a.action = 'approve' AND s.status <> 'DeletionRequested' OR a.action = 'delete' AND NOT (s.holds = 0 AND s.status IN ('DeletionApproved', 'Expired'))
    FROM s JOIN a ON a.data_id = s.data_id AND a.i = s.i + 1)"""


def _log(spark, base):
    ev = G._events(spark, base)
    u, day = F.col("user_id"), lambda x: F.lit(x).cast("timestamp")
    r = ev.select("user_id").distinct().where("user_id % 10 <> 9")
    r = r.select(u.alias("data_id"), F.element_at(F.array(*[F.lit(x) for x in ("DeletionRequested", "Expired", "DeletionApproved", "Active", "Active")]), (u % 5 + 1).cast("int")).alias("status"), (u % 3 == 0).cast("long").alias("holds"), F.when(u % 2 == 0, day("2024-01-15")).otherwise(day("2024-02-15")).alias("expires_at"))
    kind = F.create_map(*[F.lit(x) for kv in {"signup": "hold", "error": "release", "view": "request", "click": "approve", "purchase": "delete"}.items() for x in kv])
    return r, ev.select(u.alias("data_id"), F.col("event_id").alias("id"), "ts", F.element_at(kind, F.col("event_type")).alias("action"))


@query(_REPLAY + " SELECT data_id, id, action, status, holds, rejected FROM s WHERE i > 0 UNION ALL SELECT data_id, id, action, NULL, NULL, true FROM a WHERE data_id % 10 = 9")
def retention_replay(spark, base):
    """Each action of the log with what it leads to; actions on no record are turned away."""
    return retention_log.replay(*_log(spark, base), every_days=5).drop("ts")


@query(_REPLAY + " SELECT data_id, arg_max(status, i) AS status, arg_max(holds, i) AS holds FROM s GROUP BY 1")
def retention_after_log(spark, base):
    r, a = _log(spark, base)
    return retention_log.final(retention_log.replay(r, a, every_days=5), r)


@query(f"WITH {G._RECORDS} SELECT status, sum(CAST(hold AS INTEGER) + CAST(data_id % 4 = 0 AS INTEGER))::BIGINT AS holds, count(*) AS n FROM (SELECT data_id, hold, CASE WHEN data_id % 4 = 0 THEN CASE WHEN data_id % 8 = 0 THEN CASE WHEN expires_at < TIMESTAMP '2000-01-01' THEN 'Expired' ELSE 'Active' END ELSE 'LegalHold' END ELSE status END AS status FROM x) GROUP BY 1")
def hold_changes(spark, base):
    """Holds put on every fourth record and lifted from every eighth."""
    r = G._records(spark, base)
    r = c.with_hold(r, r.where("data_id % 4 = 0").select("data_id", F.lit(None).cast("timestamp").alias("expires_at")))
    r = c.without_holds(r, r.where("data_id % 8 = 0").select("data_id"), G._then())
    return r.groupBy("status").agg(F.sum(F.size("holds")).alias("holds"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def audit_purge(spark, base):
    p = c.purged(G._events(spark, base), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return p.agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("oldest"))


@query(f"WITH {G._AUDIT} SELECT event_id, severity FROM a ORDER BY CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, event_id LIMIT 50 OFFSET 25")
def audit_sort_severity(spark, base):
    return c.audit_sorted(G._audit(spark, base), "severity", limit=50, offset=25).select("event_id", "severity")


@query(f"WITH {G._AUDIT} SELECT event_id, duration_ms FROM a ORDER BY duration_ms, event_id LIMIT 40")
def audit_sort_duration(spark, base):
    return c.audit_sorted(G._audit(spark, base), "duration", descending=False, limit=40).select("event_id", "duration_ms")


@query(f"WITH {G._AUDIT} SELECT severity, count(*) AS n FROM a WHERE severity IN ('Medium', 'High', 'Critical') GROUP BY 1")
def audit_gate(spark, base):
    a = G._audit(spark, base)
    return a.where(c.should_log(F.col("severity"), "Medium")).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN false ELSE true END AS success, CASE WHEN event_type = 'error' THEN 'High' ELSE 'Info' END AS severity, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events")
def audit_build(spark, base):
    """Events built from what happened; an error makes one failed and High."""
    ev = G._events(spark, base)
    made = g.audit_event(F.col("event_type"), F.col("event_type"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", "failed"))
    return ev.select("event_id", *[x for x in made]).select("event_id", "success", "severity", "error")


# API keys: customers as keys, orders as their uses.
_KEYS = "k AS (SELECT c_custkey AS key_id, c_name AS owner, CASE c_mktsegment WHEN 'BUILDING' THEN ['All'] WHEN 'MACHINERY' THEN ['Read', 'Write'] ELSE ['Read'] END AS permissions, c_acctbal > 0 AS active, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1996-01-01' WHEN c_custkey % 4 = 1 THEN TIMESTAMP '1999-01-01' END AS expires_at FROM customer)"


def _keys(spark, base):
    k = t.read(spark, base, "customer")
    seg = F.col("c_mktsegment")
    day = lambda x: F.lit(x).cast("timestamp")
    m = F.col("c_custkey") % 4
    return k.select(F.col("c_custkey").alias("key_id"), F.col("c_name").alias("owner"), F.when(seg == "BUILDING", F.array(F.lit("All"))).when(seg == "MACHINERY", F.array(F.lit("Read"), F.lit("Write"))).otherwise(F.array(F.lit("Read"))).alias("permissions"), (F.col("c_acctbal") > 0).alias("active"), F.when(m == 0, day("1996-01-01")).when(m == 1, day("1999-01-01")).alias("expires_at"))


@query(f"WITH {_KEYS}, u AS (SELECT o_custkey AS key_id, count(*) AS n FROM orders GROUP BY 1), v AS (SELECT k.*, coalesce(n, 0) AS n, active AND (expires_at IS NULL OR expires_at >= TIMESTAMP '1997-01-01') AS valid FROM k LEFT JOIN u ON u.key_id = k.key_id) SELECT key_id, owner, valid, list_contains(permissions, 'All') OR list_contains(permissions, 'Write') AS permitted, CASE WHEN valid THEN n ELSE 0 END AS usage_count FROM v")
def key_authorisation(spark, base):
    uses = t.read(spark, base, "orders").select(F.col("o_custkey").alias("key_id"))
    return c.authorised(_keys(spark, base), uses, F.lit("1997-01-01").cast("timestamp"), "Write")


@query("SELECT c_custkey AS key_id, sha256('key-' || c_name) AS hash FROM customer")
def key_hashes(spark, base):
    """What is kept of a key instead of it."""
    return t.read(spark, base, "customer").select(F.col("c_custkey").alias("key_id"), crypto.key_hash(F.concat(F.lit("key-"), "c_name")).alias("hash"))


@query(f"WITH {_KEYS} SELECT count(*) + 1 AS total, count(*) FILTER (active AND key_id % 10 <> 0) + 1 AS active FROM k")
def key_lifecycle(spark, base):
    """Every tenth key revoked and one issued."""
    k = _keys(spark, base)
    k = c.revoked(k, k.where("key_id % 10 = 0").select("key_id"))
    k = c.issued(k, spark.createDataFrame([(-1, "new", ["Read"])], "key_id long, owner string, permissions array<string>"))
    return k.agg(F.count("*").alias("total"), F.count_if("active").alias("active"))


@query(f"WITH {_KEYS} SELECT key_id, owner FROM k WHERE active ORDER BY owner, key_id LIMIT 25 OFFSET 25")
def key_listing(spark, base):
    return ranking.page(_keys(spark, base).where("active"), 2, 25, F.col("owner"), F.col("key_id")).select("key_id", "owner")


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'api_key:' || user_id WHEN user_id % 3 = 1 THEN '10.0.0.' || user_id ELSE 'unknown' END AS client, CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 10000 ELSE 1000 END ELSE 100 END AS hourly, count(*) AS n FROM events GROUP BY 1, 2")
def client_limits(spark, base):
    ev = G._events(spark, base)
    u = F.col("user_id")
    key, ip = F.when(u % 3 == 0, u.cast("string")), F.when(u % 3 == 1, F.concat(F.lit("10.0.0."), u.cast("string"), F.lit(", 10.1.1.1")))
    r = ev.select(g.client(key, ip, F.lit(None).cast("string")).alias("client"), c.client_limit(c.client_kind(key, u % 2 == 0)).alias("hourly"))
    return r.groupBy("client", "hourly").agg(F.count("*").alias("n"))


@query(G.SQL["rate_limit_fixed_window"].replace(">= 86400000000", "> 86400000000"))
def rate_limit_strict(spark, base):
    """A window that ends only when more than its time has passed."""
    return g.fixed_window(G._events(spark, base), limit=5, seconds=86_400, strict=True)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, event_id, i, t AS f, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS place FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN place + 1 = 4 OR e.t - f >= 172800000000 THEN e.t ELSE f END, CASE WHEN place + 1 = 4 OR e.t - f >= 172800000000 THEN batch + 1 ELSE batch END, CASE WHEN place + 1 = 4 OR e.t - f >= 172800000000 THEN 0 ELSE place + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, event_id, batch, place FROM s"""
)
def request_batches(spark, base):
    """Batches that close with four requests or two days after the first."""
    return g.batches(G._events(spark, base), size=4, wait_us=2 * 86_400_000_000)


# What a stream has closed when its watermark, ten minutes behind the last event, has passed.
_CLOSED = """WITH RECURSIVE l AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS u FROM events), e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events, l WHERE ts <= u),
    s AS (SELECT user_id, event_id, i, t AS f, CAST(0 AS BIGINT) AS batch, 0 AS place FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN place + 1 = 4 OR e.t - f >= 172800000000 THEN e.t ELSE f END, CASE WHEN place + 1 = 4 OR e.t - f >= 172800000000 THEN batch + 1 ELSE batch END, CASE WHEN place + 1 = 4 OR e.t - f >= 172800000000 THEN 0 ELSE place + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1),
    b AS (SELECT user_id AS client, min(f) AS f, CAST(count(*) AS INTEGER) AS n, string_agg(event_id, ',' ORDER BY i) AS ids FROM s GROUP BY user_id, batch)
    SELECT client, make_timestamp(f) AS opened, n, CASE WHEN n = 4 THEN 'size' ELSE 'wait' END AS closed_by, ids FROM b, l WHERE n = 4 OR epoch_us(u) - f >= 172800000000"""


@query(_CLOSED)
def request_batches_stream(spark, base):
    """The batcher as a stream with timers, run to its end and started again from its checkpoint."""
    path = shared_path(spark, "batches")
    for _ in range(2):
        ev = st.read_events(spark, f"{base}/events.parque[t]").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), "ts")
        batcher.write(batcher.batches(ev, 4, 2 * 86_400_000_000), f"{path}/closed", f"{path}/state").awaitTermination()
    out = spark.read.schema(batcher.CLOSED).parquet(f"{path}/closed")
    return out.select("client", F.col("opened").cast("timestamp_ntz").alias("opened"), "n", "closed_by", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("WITH b AS (SELECT event_type, CASE WHEN value > 100 THEN user_id END AS batch FROM events) SELECT count(*) AS requests, count(DISTINCT batch) AS batches, round(count(batch) / count(DISTINCT batch), 6) AS mean_size, round(100 * count(batch) / count(*), 6) AS efficiency FROM b")
def batch_statistics(spark, base):
    return g.batch_efficiency(G._events(spark, base).select(F.when(F.col("value") > 100, F.col("user_id")).alias("batch")))


@query("SELECT count(DISTINCT user_id) AS connections, count(*) FILTER (event_type <> 'view') AS idle, round(100 * count(*) FILTER (value > 250) / count(*), 6) AS efficiency FROM events")
def pool_statistics(spark, base):
    ev = G._events(spark, base)
    return g.pool_efficiency(ev.select(F.col("user_id").alias("connection"), (F.col("value") > 250).alias("reused"), (F.col("event_type") == "view").alias("open")))


@query("SELECT conv_id, turn, 'BATCH[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']: ' || translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS line FROM conversations")
def batch_lines(spark, base):
    """Capitals of A to Z only, as the two sides know different ones beyond them."""
    r = t.read(spark, base, "conversations")
    return records.batch_lines(r, "conv_id", "turn", "text", upper=lambda x: F.translate(x, string.ascii_lowercase, string.ascii_uppercase)).select("conv_id", "turn", "line")


# Metrics.
_POINTS = "pt AS (SELECT event_type AS name, user_id % 3 AS shard, value, ts, event_id FROM events)"


def _points(spark, base):
    ev = G._events(spark, base)
    return ev.select(F.col("event_type").alias("name"), F.create_map(F.lit("shard"), (F.col("user_id") % 3).cast("string")).alias("labels"), F.col("value"), "ts", "event_id")


@query(f"WITH {_POINTS} SELECT event_id, name || '{{shard=\"' || shard || '\"}}' AS metric, epoch_us(ts) // 1000000 AS at FROM pt")
def metrics_prometheus(spark, base):
    lines = g.prometheus(_points(spark, base).withColumn("value", F.col("event_id")))
    x = F.split("line", " ")
    return lines.select(x[1].cast("long").alias("event_id"), x[0].alias("metric"), x[2].cast("long").alias("at"))


@query(f"WITH {_POINTS} SELECT event_id, CAST(json_object('name', name, 'labels', json_object('shard', CAST(shard AS VARCHAR)), 'value', event_id, 'timestamp', epoch_us(ts) // 1000000) AS VARCHAR) AS json FROM pt")
def metrics_json(spark, base):
    p = _points(spark, base).withColumn("value", F.col("event_id"))
    return g.metrics_json(p).select(F.get_json_object("json", "$.value").cast("long").alias("event_id"), "json")


@query(f"WITH {_POINTS} SELECT '<tr><td>' || name || '</td><td>{{\"shard\":\"' || shard || '\"}}</td><td>' || event_id || '</td></tr>' AS \"row\" FROM pt")
def metrics_html(spark, base):
    return g.metrics_html(_points(spark, base).withColumn("value", F.col("event_id")))


@query(f"WITH {_POINTS} SELECT count(*) AS total_metrics, count(DISTINCT name) AS names, min(ts) AS first, max(ts) AS last FROM pt")
def metrics_summary(spark, base):
    s = g.metrics_summary(_points(spark, base))
    return s.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


# Queries and their statistics.
@query(f"WITH {X._TURNS}, k AS (SELECT {X._CLASS} AS kind FROM u) SELECT kind, count(*) AS n FROM k GROUP BY 1")
def query_type_distribution(spark, base):
    return records.distribution(X._turns(spark, base).select(Q.classify(F.col("text")).alias("kind")), "kind")


@query(f"WITH {S._QUERIES}, {S._ANALYSIS}, k AS (SELECT CASE WHEN type IN ('Procedural', 'Navigational') THEN 'Keyword' WHEN intent = 'Learning' THEN 'Quality' WHEN temporal THEN 'Fresh' WHEN type = 'Analytical' THEN 'Semantic' ELSE 'Balanced' END AS strategy FROM a) SELECT strategy, count(*) AS n FROM k GROUP BY 1")
def strategy_usage(spark, base):
    return records.distribution(t.queries(spark, base).select(Q.strategy(Q.analysis(F.col("text"))).alias("strategy")), "strategy")


@query(
    f"""WITH {X._TURNS}, k AS (SELECT {X._CLASS} AS kind, text FROM u), z AS (SELECT kind, least(1, 0.5 + CASE WHEN strlen(text) > 20 THEN 0.2 ELSE 0 END
    + CASE WHEN kind = 'Question' AND suffix(text, '?') THEN 0.3 WHEN kind = 'Command' AND prefix(lower(text), 'show') THEN 0.2 WHEN kind = 'Technical' AND contains(lower(text), 'api') THEN 0.2 ELSE 0 END) AS c FROM k)
    SELECT kind, count(*) AS n, CAST(round(avg(c), 6) AS DOUBLE) AS confidence FROM z GROUP BY GROUPING SETS ((), (kind))"""
)
def query_batch_summary(spark, base):
    """Queries and mean confidence in all (kind null) and by type."""
    x = X._turns(spark, base).withColumn("kind", Q.classify(F.col("text")))
    return records.batch_summary(x.withColumn("confidence", Q.class_confidence(F.col("text"), F.col("kind"))), "kind", "confidence")


@query(
    rf"""WITH {X._TURNS}, w AS (SELECT conv_id, turn, {X._W.format('text')} AS w, list_filter(list_transform({X._W.format('lower(text)')}, lambda w: regexp_replace(w, '[^a-z0-9''-]', '', 'g')), lambda w: w <> '' AND NOT list_contains({X._PSTOP}, w)) AS t FROM u)
    SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS original_terms, CAST(len(t) AS INTEGER) AS processed_terms, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_terms FROM w"""
)
def processing_statistics(spark, base):
    s = Q.processing_stats(F.col("text"))
    return X._turns(spark, base).select("conv_id", "turn", s["original_terms"].alias("original_terms"), s["processed_terms"].alias("processed_terms"), s["distinct_terms"].alias("distinct_terms"))


@query(
    rf"""WITH w AS (SELECT doc_id, {X._W.format('text')} AS w FROM documents), p AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM w)
    SELECT doc_id, count(*) AS n, min(w[i] || ' ' || w[i + 1]) AS first FROM p WHERE regexp_matches(w[i], '^\p{{Lu}}') AND regexp_matches(w[i + 1], '^\p{{Lu}}') GROUP BY 1"""
)
def named_entities(spark, base):
    x = t.read(spark, base, "documents").select("doc_id", T.named_entities(F.col("text")).alias("e")).where("size(e) > 0")
    return x.select("doc_id", F.size("e").cast("long").alias("n"), F.array_min(F.transform("e", lambda x: x["text"])).alias("first"))


@query(f"SELECT doc_id, trim(text) <> '' AND strlen(text) BETWEEN 10 AND 10485760 AND NOT ({' OR '.join(f'regexp_matches(text, {X._lit(p)})' for p in lexicon.BLOCKED)}) AS valid FROM documents")
def quick_validation(spark, base):
    return t.read(spark, base, "documents").select("doc_id", V.quick_valid(F.col("text")).alias("valid"))


# Relevance beyond the scores.
@query(
    S._relevance_sql(
        f", o AS (SELECT query_id, id, unnest(['semantic similarity', 'keyword relevance', 'document quality', 'content freshness', 'context alignment']) AS k, unnest([semantic, keyword, quality, freshness, context]) AS v, unnest([1, 2, 3, 4, 5]) AS i FROM r WHERE rank <= 10), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY round(v, 9) DESC, i) AS n FROM o) SELECT query_id, id, string_agg(k, ',' ORDER BY n) AS factors FROM n WHERE n <= 3 GROUP BY 1, 2"
    )
)
def contributing_factors(spark, base):
    _, r = S._ranked(spark, base)
    five = {k: F.round(F.col(x), 9) for k, x in zip(R.FACTORS, ("semantic", "keyword", "quality", "freshness", "context"))}
    names = F.transform(R.top_factors(five), lambda x: F.substring_index(x, ":", 1))
    return r.select("query_id", "id", F.array_join(names, ",").alias("factors"))


@query(
    S._relevance_sql(
        """, z AS (SELECT *, list_filter([CASE WHEN round(semantic, 9) > 0.7 THEN 'high semantic similarity' END, CASE WHEN round(keyword, 9) > 0.6 THEN 'strong keyword match' END, CASE WHEN round(quality, 9) > 0.7 THEN 'high quality' END, CASE WHEN round(boost, 9) > 1.1 THEN 'fits the intent' END], lambda x: x IS NOT NULL) AS good,
        list_filter([CASE WHEN round(semantic, 9) < 0.3 THEN 'low semantic similarity' END, CASE WHEN round(keyword, 9) < 0.2 THEN 'weak keyword match' END, CASE WHEN round(freshness, 9) < 0.3 THEN 'may be outdated' END], lambda x: x IS NOT NULL) AS bad FROM r WHERE rank <= 10)
        SELECT query_id, id, array_to_string(good, ',') AS positive, array_to_string(bad, ',') AS negative, array_to_string(list_filter([CASE WHEN type = 'Procedural' AND NOT contains(lower(content), 'step') THEN 'look for step-by-step instructions' END, CASE WHEN type = 'Factual' AND round(quality, 9) < 0.5 THEN 'look for more authoritative sources' END, CASE WHEN len(good) = 0 THEN 'refine the query terms' END], lambda x: x IS NOT NULL), ',') AS recommendations, round(semantic, 6) AS semantic_score FROM z"""
    )
)
def relevance_explanation(spark, base):
    _, r = S._ranked(spark, base)
    five = [F.col(x) for x in ("semantic", "keyword", "quality", "freshness", "context")]
    x = r.withColumn("x", R.explanation(F.col("analysis"), F.col("content"), *five, F.col("boost")))
    return x.select("query_id", "id", F.array_join("x.positive", ",").alias("positive"), F.array_join("x.negative", ",").alias("negative"), F.array_join("x.recommendations", ",").alias("recommendations"), F.round(F.element_at("x.debug", "semantic_score"), 6).alias("semantic_score"))


@query(
    S._relevance_sql(
        f""", o AS (SELECT *, round({S._overall(lexicon.PRESETS['general'])}, 9) AS overall, (semantic + keyword + quality + freshness + context) / 5 AS m FROM r WHERE rank <= 10),
        z AS (SELECT *, round(greatest(0, least(1, 1 - sqrt(((semantic - m) ** 2 + (keyword - m) ** 2 + (quality - m) ** 2 + (freshness - m) ** 2 + (context - m) ** 2) / 5))), 9) AS confidence,
          list_filter([CASE WHEN round(semantic, 9) > 0.7 THEN 'high semantic similarity' END, CASE WHEN round(keyword, 9) > 0.6 THEN 'strong keyword match' END, CASE WHEN round(quality, 9) > 0.7 THEN 'high quality' END, CASE WHEN round(boost, 9) > 1.1 THEN 'fits the intent' END], lambda x: x IS NOT NULL) AS good FROM o),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY v DESC, i) AS n FROM (SELECT query_id, id, unnest(['semantic similarity', 'keyword relevance', 'document quality', 'content freshness', 'context alignment']) AS k, unnest([round(semantic, 9), round(keyword, 9), round(quality, 9), round(freshness, 9), round(context, 9)]) AS v, unnest([1, 2, 3, 4, 5]) AS i FROM o)),
        f AS (SELECT query_id, id, string_agg(k || ': ' || printf('%.3f', round(v, 3)), ', ' ORDER BY n) AS factors FROM n WHERE n <= 3 GROUP BY 1, 2)
        SELECT z.query_id, z.id, 'Rank ' || rank || ': overall ' || printf('%.3f', round(overall, 3)) || ' (confidence ' || printf('%.3f', round(confidence, 3)) || ')' || chr(10) || '- factors: ' || factors || chr(10) || '- for it: ' || array_to_string(good, ', ') || chr(10) || '- ' || substring(content, 1, 100) || '...' AS line FROM z JOIN f ON f.query_id = z.query_id AND f.id = z.id"""
    )
)
def explained_results(spark, base):
    """The lines that tell why each result stands where it does, whole; scores from values of 9 digits."""
    _, r = S._ranked(spark, base)
    five = {k: F.round(F.col(x), 9) for k, x in zip(R.FACTORS, ("semantic", "keyword", "quality", "freshness", "context"))}
    s = R.signals(F.col("semantic"), F.col("keyword"), F.col("quality"), F.col("boost"))
    line = R.explained(F.col("rank"), F.round("overall", 9), F.round("confidence", 9), R.top_factors(five), s["positive"], F.col("content"))
    return r.select("query_id", "id", line.alias("line"))


@query(S._relevance_sql(" UNION ALL ".join(f"SELECT '{k}' AS preset, count(*) AS n, round(avg({S._overall(w)}), 6) AS mean, round(max({S._overall(w)}), 6) AS best FROM r WHERE rank <= 10" for k, w in lexicon.PRESETS.items())))
def strategy_comparison(spark, base):
    """The same ranked rows under each preset of weights."""
    _, r = S._ranked(spark, base)
    five = [F.col(x) for x in ("semantic", "keyword", "quality", "freshness", "context")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("preset"), R.overall(*five, F.col("boost"), w).alias("overall")) for k, w in lexicon.PRESETS.items()]))
    return records.compared(r.select(each.alias("e")).select("e.preset", "e.overall"), "preset", "overall")


@query(S._relevance_sql("SELECT query_id, r.id, round(quality - 0.15 + 0.3 * coalesce(a.authority, 0.5), 6) AS quality FROM r LEFT JOIN (SELECT doc_id, quality / 4 AS authority FROM labels) a ON a.doc_id = r.id WHERE rank <= 10"))
def authority_quality(spark, base):
    """Quality with what is known of a document's authority, one half where nothing is."""
    q, d, v = S._inputs(spark, base)
    a = t.read(spark, base, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") / 4).alias("authority"))
    r = plan.relevance(q, plan.hybrid(q, d, v), S._as_of(), authority=a)
    return r.select("query_id", "id", F.round("quality", 6).alias("quality"))


_CAPPED = f"""WITH {S._Q}, s AS (SELECT query_id, id, id % 25 AS document_id, round({S._SCORES['cosine']}, 9) AS s FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS n FROM r WHERE rank <= 40) SELECT query_id, id, document_id, CAST(rank AS INTEGER) AS rank FROM n WHERE n <= 2"""


@query(_CAPPED)
def cap_per_document(spark, base):
    """Several chunks a document: no more than two of each stay."""
    found = vs.search(S._asked(spark, base), t.vectors(spark, base), 40).withColumn("document_id", F.pmod("id", F.lit(25)))
    return ranking.cap(found, 2, [F.col("rank")], "query_id", "document_id").select("query_id", "id", "document_id", "rank")


@query(S._hybrid_sql("SELECT query_id, id, round(score, 6) AS final_score, CAST(rank AS INTEGER) AS new_rank FROM h WHERE rank <= 10"))
def rerank_off(spark, base):
    return S._final(rerank.applied(S._best(spark, base), "Quality", enabled=False))


@query(
    S._hybrid_sql(
        f", z AS (SELECT *, {S._RQ} AS q FROM h WHERE rank <= 10), f AS (SELECT query_id, id, rank, score, score * CASE WHEN round(q, 9) > 0.7 THEN 1.2 WHEN round(q, 9) < 0.3 THEN 0.8 ELSE 1 END + 0.15 * q AS f FROM z), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, id) AS new_rank FROM f) SELECT 'Quality' AS strategy, count(DISTINCT query_id) AS queries, count(*) AS rows, count(*) FILTER (new_rank < rank) AS rose, count(*) FILTER (new_rank > rank) AS fell, round(avg(f - score), 6) AS mean_change FROM n"
    )
)
def rerank_improvement(spark, base):
    return rerank.improvement(rerank.quality(S._best(spark, base)), "Quality")


# Metadata records.
_FM = "'---' || chr(10) || 'title: \"Doc ' || doc_id || ': one\"' || chr(10) || 'author: ' || source || chr(10) || 'date: 2024-03-0' || (doc_id % 9 + 1) || 'T10:00:00Z' || chr(10) || 'tags: ' || lang || ', test' || chr(10) || 'kind: a' || chr(10) || 'kind: b' || chr(10) || '---' || chr(10)"


@query("SELECT doc_id, 'Doc ' || doc_id || ': one' AS title, source AS author, TIMESTAMP '2024-03-01 10:00:00' + to_days(CAST(doc_id % 9 AS INTEGER)) AS created, lang || '|test' AS tags, 'b' AS kind FROM documents")
def metadata_front_matter(spark, base):
    """Documents that are given a head of key and value lines, and what is read from it."""
    d = t.read(spark, base, "documents").withColumn("md", F.concat(F.expr(_FM.replace("chr(10)", "'\\n'")), F.col("text")))
    m = T.metadata_record(F.col("md"), F.lit("md"))
    return d.select("doc_id", m.alias("m")).select("doc_id", "m.title", "m.author", F.col("m.created_date").cast("timestamp_ntz").alias("created"), F.array_join("m.tags", "|").alias("tags"), F.element_at("m.custom_fields", "kind").alias("kind"))


@query(rf"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, 'someone' AS author, 'a|b' AS tags, 'd, e' AS description, CAST(len({X._W.format('text')}) AS BIGINT) AS words FROM (SELECT page_id, html, {X.SQL['html_text'].split('SELECT page_id, ')[1].split(' AS text FROM')[0]} AS text FROM pages)")
def metadata_html(spark, base):
    """Pages that are given meta elements, with attributes in either order."""
    p = t.read(spark, base, "pages")
    more = '<head><meta content="someone" name="Author"><meta name=\'keywords\' content=\'a, b\'><meta name="description" content="old"><meta  content=\'d, e\'  name=description>'
    m = T.metadata_record(F.replace(F.col("html"), F.lit("<head>"), F.lit(more)), F.lit("html"))
    return p.select("page_id", m.alias("m")).select("page_id", "m.title", "m.author", F.array_join("m.tags", "|").alias("tags"), F.element_at("m.custom_fields", "description").alias("description"), F.col("m.word_count").alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'second' END AS author, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'other' END AS tags, 'p' AS both, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS fields FROM documents")
def metadata_record_merge(spark, base):
    d = t.read(spark, base, "documents")
    even = F.col("doc_id") % 2 == 0
    third = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("first"))).otherwise(F.array().cast("array<string>"))
    one = T.record(author=F.when(even, F.col("lang")), tags=third, fields=F.when(even, F.create_map(F.lit("k"), F.lit("p"), F.lit("x"), F.lit("1"))).otherwise(F.create_map(F.lit("k"), F.lit("p"))))
    two = T.record(author=F.lit("second"), tags=F.array(F.lit("other")), fields=F.create_map(F.lit("k"), F.lit("q"), F.lit("y"), F.lit("2")))
    return d.select("doc_id", T.merged_record(one, two).alias("m")).select("doc_id", "m.author", F.array_join("m.tags", ",").alias("tags"), F.element_at("m.custom_fields", "k").alias("both"), F.size("m.custom_fields").alias("fields"))


@query(f"SELECT doc_id, CAST(len({X._W.format('text')}) AS BIGINT) AS word_count, 'en' AS language FROM documents")
def basic_metadata(spark, base):
    return t.read(spark, base, "documents").select("doc_id", T.basic_record(F.col("text")).alias("m")).select("doc_id", "m.word_count", "m.language")


# SQL functions.
@query(f"WITH {S._Q}, s AS (SELECT query_id, id, e, round({S._SCORES['cosine']}, 9) AS s FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 6) AS score, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM r WHERE rank <= 10")
def sql_functions(spark, base):
    """The engine's functions by name in SQL, over the pairs of the stated queries and what the search finds among all vectors."""
    sqlfunctions.register(spark)
    v = t.vectors(spark, base)
    v.createOrReplaceTempView("cq_vectors")
    vs.search(S._asked(spark, base), v, 10).createOrReplaceTempView("cq_found")
    return spark.sql("SELECT query_id, f.id, round(cq_cosine_score(q.embedding, v.embedding), 6) AS score, round(cq_norm(v.embedding), 6) AS norm FROM cq_found f JOIN cq_vectors q ON q.id = f.query_id JOIN cq_vectors v ON v.id = f.id")


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, length(substring(text, i * 800 + 1, 1000)) AS n FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM documents)")
def sql_chunks(spark, base):
    """The chunks of a text as a function of SQL that makes an array."""
    sqlfunctions.register(spark)
    t.read(spark, base, "documents").createOrReplaceTempView("cq_documents")
    return spark.sql("SELECT doc_id, i AS chunk_index, length(c) AS n FROM (SELECT doc_id, posexplode(cs) AS (i, c) FROM (SELECT doc_id, cq_chunks(text, 1000, 200) AS cs FROM cq_documents))")


@query(
    r"""SELECT doc_id, 'chunk' AS kind, CAST(i AS VARCHAR) AS name, CAST(i * 800 AS VARCHAR) || ':' || length(substring(text, i * 800 + 1, 1000)) AS value FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM documents)
    UNION ALL SELECT doc_id, 'front', unnest(['title', 'author', 'url']), unnest(['Doc ' || doc_id || ': one', source, 'http://x']) FROM documents"""
)
def sql_table_functions(spark, base):
    """Chunks with their places and the entries of a head, as tables that SQL views laterally; nothing is shuffled."""
    sqlfunctions.register(spark)
    t.read(spark, base, "documents").createOrReplaceTempView("cq_documents")
    return spark.sql(
        r"""SELECT doc_id, 'chunk' AS kind, CAST(chunk_index AS STRING) AS name, concat(start, ':', length(content)) AS value FROM (SELECT doc_id, cq_chunk_places(text, 1000, 200) AS cs FROM cq_documents) LATERAL VIEW inline(cs) c
        UNION ALL SELECT doc_id, 'front', name, value FROM (SELECT doc_id, cq_front_entries(concat('---\ntitle: "Doc ', doc_id, ': one"\nauthor: ', source, '\nno entry\nurl: http://x\n---\n', text)) AS es FROM cq_documents) LATERAL VIEW inline(es) f"""
    )


@query(
    """WITH RECURSIVE c AS (SELECT doc_id, i, substring(text, i * 800 + 1, 1000) AS c FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM documents)),
    f AS (SELECT doc_id, i, 0 AS context, i AS first, c AS held FROM c WHERE i = 0
    UNION ALL SELECT c.doc_id, c.i, CASE WHEN length(held) + 2 + length(c) <= 2500 THEN context ELSE context + 1 END, CASE WHEN length(held) + 2 + length(c) <= 2500 THEN first ELSE c.i END, CASE WHEN length(held) + 2 + length(c) <= 2500 THEN held || chr(10) || chr(10) || c ELSE c END
    FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1)
    SELECT doc_id AS document_id, context, CAST(first AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, arg_max(held, i) AS content FROM f GROUP BY 1, 2, 3"""
)
def sql_contexts(spark, base):
    """Chunks packed into contexts by a table function over an ordered partition."""
    sqlfunctions.register(spark)
    chunking.chunks(t.read(spark, base, "documents").select("doc_id", "text")).createOrReplaceTempView("cq_document_chunks")
    return spark.sql("SELECT * FROM cq_contexts(TABLE(SELECT document_id, chunk_index, content FROM cq_document_chunks) PARTITION BY (document_id) ORDER BY (chunk_index), 2500)")
