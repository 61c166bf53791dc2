"""Audit, retention, consent, limits, metrics, caches and streams, over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.functions import lexicon
from corpusql.operators import governance as g
from corpusql.operators import ranking
from corpusql.plans import answer
from corpusql.sources import buckets, tables as t
from corpusql.session import shared_path
from corpusql.streaming import events as st

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _events(spark, base):
    return t.read(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_SEVERITY = "CASE WHEN event_type = 'error' THEN 'High' WHEN event_type = 'signup' THEN 'Medium' WHEN event_type = 'purchase' THEN 'Critical' ELSE 'Info' END"
_AUDIT = f"a AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, {_SEVERITY} AS severity, event_type <> 'error' AS success, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS data_size, ts FROM events)"


def _audit(spark, base):
    e = _events(spark, base)
    severity = F.when(F.col("event_type") == "error", "High").when(F.col("event_type") == "signup", "Medium").when(F.col("event_type") == "purchase", "Critical").otherwise("Info")
    return e.select(
        "event_id",
        "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        severity.alias("severity"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("data_size"),
        "ts",
    )


def _set(kind: str, column: str) -> str:
    group = "" if column == "''" else f" GROUP BY {column}"
    return f"SELECT '{kind}' AS kind, {column} AS name, count(*) AS n, count(*) FILTER (NOT success) AS failed, round(avg(duration_ms), 6) AS avg_duration, CAST(coalesce(sum(data_size), 0) AS BIGINT) AS bytes FROM a{group}"


@query(f"WITH {_AUDIT} " + " UNION ALL ".join(_set(k, c) for k, c in (("all", "''"), ("event_type", "event_type"), ("user_id", "user_id"), ("severity", "severity"))))
def audit_report_grouping_sets(spark, base):
    return g.audit_report(_audit(spark, base))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def audit_counts(spark, base):
    return _events(spark, base).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def audit_top_users(spark, base):
    return g.top_users(_events(spark, base))


@query(f"WITH {_AUDIT} SELECT event_id FROM a WHERE event_type IN ('error', 'purchase') AND severity IN ('Critical', 'High') AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'")
def audit_search(spark, base):
    import datetime as dt

    return _audit(spark, base).where(g.audit_filter(types=["error", "purchase"], severity="High", since=dt.datetime(2024, 1, 10), until=dt.datetime(2024, 1, 20))).select("event_id")


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate([1, 10, 50, 100, 200, 500])) + ', round(sum(value), 6) AS "sum", count(value) AS "count" FROM events GROUP BY 1')
def histogram_buckets(spark, base):
    return g.histogram(_events(spark, base), "value", [1, 10, 50, 100, 200, 500], "event_type")


@query("SELECT event_type AS name, CAST(user_id AS VARCHAR) AS labels, round(sum(value), 6) AS total, arg_max(value, ts::VARCHAR || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS last FROM events GROUP BY 1, 2")
def counter_gauge(spark, base):
    e = _events(spark, base).select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("labels"), "value", "ts", F.col("event_id").alias("id"))
    return g.counters(e)


# Cache entries: one for each user and type of events, as the events would have made them.
_CACHE = """c AS (SELECT user_id || '/' || event_type AS key, count(*) AS access_count, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS size_bytes, min(ts) AS created_at, max(ts) AS last_accessed FROM events GROUP BY user_id, event_type)"""


def _cache(spark, base):
    e = _events(spark, base)
    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key")
    size = F.get_json_object("props", "$.k").cast("long")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("access_count"), F.sum(size).alias("size_bytes"), F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed"))
    return c.select(key, "access_count", "size_bytes", "created_at", "last_accessed", (F.col("created_at") + F.make_dt_interval(F.lit(30))).alias("expires_at"))


@query(f"WITH {_CACHE} SELECT count(*) AS n, count(*) FILTER (access_count > 5) AS hits, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (access_count > 5) / count(*), 6) END AS hit_rate FROM c")
def cache_hit_rate(spark, base):
    r = g.hit_rate(_cache(spark, base).withColumn("hit", F.col("access_count") > 5))
    return r.withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"WITH {_CACHE} SELECT key FROM c ORDER BY last_accessed DESC, key LIMIT 100")
def cache_evict_lru(spark, base):
    return g.evict(_cache(spark, base), "lru", 100).select("key")


@query(f"WITH {_CACHE} SELECT key FROM c ORDER BY access_count DESC, key LIMIT 100")
def cache_evict_lfu(spark, base):
    return g.evict(_cache(spark, base), "lfu", 100).select("key")


@query(f"WITH {_CACHE}, r AS (SELECT key, sum(size_bytes) OVER (ORDER BY last_accessed DESC, key ROWS UNBOUNDED PRECEDING) AS s FROM c) SELECT key FROM r WHERE s <= 20000")
def cache_evict_bytes(spark, base):
    return g.evict_bytes(_cache(spark, base), 20_000).select("key")


@query(f"WITH {_CACHE} SELECT key FROM c WHERE created_at + to_days(30) >= TIMESTAMP '2024-02-01'")
def cache_unexpired(spark, base):
    return g.unexpired(_cache(spark, base), _as_of()).select("key")


@query("SELECT count(*) AS hits, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)) AS misses FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def cache_split_counts(spark, base):
    d = t.read(spark, base, "documents").select(F.col("doc_id").alias("id"))
    hit, miss = g.cache_split(d, t.vectors(spark, base).select("id"), "id")
    return hit.agg(F.count("*").alias("hits")).crossJoin(miss.agg(F.count("*").alias("misses")))  # one row each


# Retention records: orders, with holds on urgent ones.
_DAYS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicon.RETENTION_DAYS.items())
_RECORDS = f"""r0 AS (SELECT o_orderkey AS data_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Audit' WHEN '2-HIGH' THEN 'Account' WHEN '3-MEDIUM' THEN 'Query' WHEN '5-LOW' THEN 'Document' ELSE 'System' END AS data_type, o_orderdate AS created_at,
    o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS data_size, o_orderkey % 10 = 0 AS hold, o_orderkey % 20 = 0 AS active FROM orders),
    r AS (SELECT *, created_at + to_days(CASE data_type {_DAYS} ELSE 365 END) AS expires_at FROM r0), x AS (SELECT *, expires_at < TIMESTAMP '2000-01-01' AND NOT hold AS expired, hold AND active AS held FROM r)"""


def _records(spark, base):
    o = t.read(spark, base, "orders")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "Audit").when(p == "2-HIGH", "Account").when(p == "3-MEDIUM", "Query").when(p == "5-LOW", "Document").otherwise("System")
    hold = F.array(F.struct((F.col("o_orderkey") % 20 == 0).alias("active"), F.lit(None).cast("timestamp").alias("expires_at")))
    none = F.array().cast("array<struct<active:boolean,expires_at:timestamp>>")
    return g.with_policy(
        o.select(
            F.col("o_orderkey").alias("data_id"),
            kind.alias("data_type"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.col("o_orderstatus").alias("status"),
            F.floor("o_totalprice").cast("long").alias("data_size"),
            F.when(F.col("o_orderkey") % 10 == 0, hold).otherwise(none).alias("holds"),
        )
    )


def _then():
    return F.lit("2000-01-01 00:00:00").cast("timestamp")


@query(f"WITH {_RECORDS} SELECT data_id, expired, held FROM x")
def retention_status(spark, base):
    return _records(spark, base).select("data_id", g.expired(_then()).alias("expired"), g.held(_then()).alias("held"))


@query(
    f"""WITH {_RECORDS} SELECT status, data_type, count(*) AS records, CAST(sum(data_size) AS BIGINT) AS bytes, count(*) FILTER (expired) AS expired, count(*) FILTER (expires_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-01-31') AS expiring,
    count(*) FILTER (held) AS held, CAST(coalesce(sum(data_size) FILTER (expired), 0) AS BIGINT) AS savings FROM x GROUP BY 1, 2"""
)
def retention_report(spark, base):
    return g.retention_report(_records(spark, base), _then())


@query(f"WITH {_RECORDS} SELECT CASE WHEN held THEN 'held' WHEN NOT expired THEN 'keep' WHEN data_type IN ('Audit', 'Account') AND status <> 'Approved' THEN 'request' ELSE 'delete' END AS decision, count(*) AS n, CAST(sum(data_size) AS BIGINT) AS bytes FROM x GROUP BY 1")
def retention_processing(spark, base):
    return g.retention_decisions(_records(spark, base), _then()).groupBy("decision").agg(F.count("*").alias("n"), F.sum("data_size").alias("bytes"))


# Consents: the event log, a click gives and an error withdraws.
@query("SELECT user_id, event_type AS purpose, coalesce(bool_or(value > 20 AND NOT value > 400 AND ts + to_days(20) > TIMESTAMP '2024-02-01'), false) AS valid FROM events GROUP BY 1, 2")
def consent_valid(spark, base):
    c = _events(spark, base).select("user_id", F.col("event_type").alias("purpose"), (F.col("value") > 20).alias("consent_given"), (F.col("value") > 400).alias("withdrawn"), (F.col("ts") + F.make_dt_interval(F.lit(20))).alias("expires_at"))
    return g.valid_consents(c, _as_of())


@query("SELECT user_id, arg_max(event_type, ts::VARCHAR || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS event_type FROM events GROUP BY 1")
def latest_state(spark, base):
    e = _events(spark, base).select("user_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return g.latest(e, "user_id", order="o").select("user_id", "event_type")


@query("SELECT user_id, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.value > 300) GROUP BY 1")
def erasure(spark, base):
    e = _events(spark, base)
    return g.erase(e, e.where("event_type = 'signup' AND value > 300")).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    s AS (SELECT user_id, i, t AS st, 1 AS c, 1 AS allowed, 0 AS rejected, 1 AS windows FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t - st >= 86400000000 THEN e.t ELSE st END, CASE WHEN e.t - st >= 86400000000 THEN 1 WHEN c < 5 THEN c + 1 ELSE c END,
      allowed + CASE WHEN e.t - st >= 86400000000 OR c < 5 THEN 1 ELSE 0 END, rejected + CASE WHEN e.t - st >= 86400000000 OR c < 5 THEN 0 ELSE 1 END, windows + CASE WHEN e.t - st >= 86400000000 THEN 1 ELSE 0 END
      FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, i AS n, CAST(allowed AS BIGINT) AS allowed, CAST(rejected AS BIGINT) AS rejected, CAST(windows AS BIGINT) AS windows FROM s WHERE i = (SELECT max(i) FROM e WHERE e.user_id = s.user_id)"""
)
def rate_limit_fixed_window(spark, base):
    return g.fixed_window(_events(spark, base), limit=5, seconds=86_400)


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 4) AS running_avg, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 999 PRECEDING) + 1e-9, 4) AS moving_avg FROM events")
def running_average(spark, base):
    r = g.running_average(_events(spark, base), "value", ["event_type"], ["ts", "event_id"])
    r = g.moving_average(r, "value", ["event_type"], ["ts", "event_id"])
    return r.select("event_id", F.round(F.col("running_avg") + 1e-9, 4).alias("running_avg"), F.round(F.col("moving_avg") + 1e-9, 4).alias("moving_avg"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS cached, count(*) FILTER (event_type = 'error') AS failed, max(value) AS slowest, count(*) FILTER (value > 400) AS slow, round(avg(value), 6) AS average FROM events")
def query_statistics(spark, base):
    e = _events(spark, base).select((F.col("event_type") == "view").alias("cached"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("duration"))
    return g.query_stats(e, 400)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows_tumbling(spark, base):
    return st.tumbling(_events(spark, base)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paginate(spark, base):
    return ranking.page(t.read(spark, base, "orders"), 3, 50, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages, 3 < ceil(count(*) / 50) AS has_next, true AS has_previous FROM orders")
def page_information(spark, base):
    return ranking.page_info(t.read(spark, base, "orders"), 3, 50)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size = 7 AND p_brand LIKE '%#1%' ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def builder_select_like(spark, base):
    return ranking.select_rows(t.read(spark, base, "part"), ["p_partkey", "p_name", "p_brand"], equal={"p_size": 7}, like={"p_brand": "#1"}, order=[("p_retailprice", False), ("p_partkey", True)], limit=25)


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7 AND p_brand LIKE '%#1%' ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def builder_sql_text(spark, base):
    """The builder's text, run as SQL."""
    t.read(spark, base, "part").createOrReplaceTempView("cq_part")
    return spark.sql(ranking.select_sql("cq_part", ["p_partkey", "p_name"], equal={"p_size": 7}, like={"p_brand": "#1"}, order=[("p_retailprice", False), ("p_partkey", True)], limit=25))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F' AND NOT o_orderdate < TIMESTAMP '1996-01-01') AS active, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS expired FROM orders")
def key_statistics(spark, base):
    k = t.read(spark, base, "orders").select((F.col("o_orderstatus") != "F").alias("active"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    return g.key_stats(k, F.lit("1996-01-01 00:00:00").cast("timestamp"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled' FROM labels")
def upsert_by_key(spark, base):
    old = t.read(spark, base, "documents").select("doc_id", "lang")
    new = t.read(spark, base, "labels").select("doc_id", F.lit("labelled").alias("lang"))
    return t.upsert(old, new, "doc_id")


@query(
    """WITH n AS (SELECT vec_id AS id, label + 100 AS label, -embedding[1] AS first FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 11 <> 0 UNION ALL SELECT vec_id + 1000000, label, embedding[1] FROM embeddings WHERE vec_id % 50 = 0),
    a AS (SELECT * FROM n UNION ALL SELECT vec_id, label, embedding[1] FROM embeddings WHERE vec_id NOT IN (SELECT id FROM n))
    SELECT id, label, round(first::DOUBLE, 6) AS first FROM a WHERE id % 13 <> 0"""
)
def upsert_buckets(spark, base):
    """Vectors changed, added and deleted in a table of buckets; new rows without a vector are skipped."""
    v = t.vectors(spark, base)
    path = shared_path(spark, "vectors")
    buckets.create(v, path, "id", buckets=16)
    changed = v.where("id % 7 = 0").select("id", F.when(F.col("id") % 11 != 0, F.transform("embedding", lambda x: -x)).alias("embedding"), (F.col("label") + 100).alias("label"))
    added = v.where("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000)
    buckets.upsert(path, v.schema, changed.unionByName(added).where("embedding is not null"), "id", buckets=16)
    buckets.delete(path, v.schema, buckets.read(spark, path, v.schema).where("id % 13 = 0").select("id"), "id", buckets=16)
    return buckets.read(spark, path, v.schema).select("id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(SQL["event_windows_tumbling"])
def stream_tumbling_windows(spark, base):
    """The stream of the events file, in windows, brought to its end in a table and read back."""
    out = shared_path(spark, "stream")
    windows = st.tumbling(st.read_events(spark, f"{base}/[e]vents.parquet"), late="0 seconds")
    st.run_to_table(windows, out)
    return spark.read.schema(windows.schema).parquet(f"{out}/table").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 4) AS mean_so_far FROM events")
def running_latency(spark, base):
    return answer.running_latency(_events(spark, base)).select("event_id", F.round(F.col("mean_so_far") + 1e-9, 4).alias("mean_so_far"))
