"""Providers, caches, errors, records and streams where SQL has no say."""

import datetime as dt

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from corpusql import errors, schemas
from corpusql.functions import query_text as Q
from corpusql.functions import relevance as R
from corpusql.functions import text as T
from corpusql.functions import vectors as V
from corpusql.operators import caching, compliance as c
from corpusql.operators import embedding as e
from corpusql.operators import governance as g
from corpusql.operators import records, vector_search as vs
from corpusql.session import shared_path
from corpusql.sources import files, tables
from corpusql.streaming import events


def failing():
    def broken(texts):  # made here, so that workers get it by value
        raise OSError("away")

    return broken


def test_providers_fall_back():
    calls = []

    def counted(texts):
        calls.append(len(texts))
        return e.ramp(texts, 3)

    good, bad = e.Provider("good", 3, counted, max_batch=2), e.Provider("bad", 3, failing())
    x, name = e.embed_batch(["a", "b", "c"], [bad, good], retries=2, pause=0)
    assert name == "good" and x.shape == (3, 3) and calls == [2, 1]
    with pytest.raises(errors.EmbeddingError):
        e.embed_batch(["a"], [bad], retries=1)
    with pytest.raises(errors.EmbeddingError):
        e.embed_batch(["a"], [e.Provider("wrong", 3, lambda t: np.zeros((len(t), 2)))], retries=1)
    assert e.ramp(["ab"], 2)[0].tolist() == [((31 * 97 + 98 + i) / 2**32 - 0.5) * 0.2 for i in range(2)]


def test_embedded_tables(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, None, "y"), (3, "", "z"), (4, "w" * 600, "q"), (1, "abc", "x")], "id long, text string, provider string")
    out = e.embedded(df, "text", [e.Provider("bad", 8, failing()), e.local(dimension=8)], retries=1, pause=0).collect()
    assert [(r.id, r.provider, r.embed_issue, r.embedding is not None) for r in sorted(out, key=lambda r: r.id)] == [(1, "local", None, True)] * 2 + [(2, None, "null", False), (3, None, "empty", False), (4, "local", None, True)]
    strict = e.embedded(df, "text", [e.local(dimension=8)], strict=True)
    with pytest.raises(Exception, match="embedding input"):
        strict.collect()
    with pytest.raises(ValueError):
        e.embedded(df, "text", [e.local(dimension=8), e.TOY])
    stats = {r.provider: (r.texts, r.vectors) for r in e.provider_stats(e.embedded(df, "text", [e.local(dimension=8, max_bytes=100)])).collect()}
    assert stats == {"local": (2, 2), None: (3, 0)}
    assert e.embedded(df.limit(0), "text", [e.TOY]).count() == 0


def test_cache_life(spark):
    now = dt.datetime(2024, 1, 1)
    at = F.lit(now)
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    empty = spark.createDataFrame([], "key string, embedding array<double>, size_bytes long, created_at timestamp, last_accessed timestamp, access_count long, expires_at timestamp")
    found, cache = e.get_or_compute(df, empty, "text", [e.TOY], at, model="m", ttl_days=2)
    assert {r.status for r in found.collect()} == {"miss"} and sorted(r.access_count for r in cache.collect()) == [1, 2]
    on_time, late = F.lit(now + dt.timedelta(days=2)), F.lit(now + dt.timedelta(days=2, seconds=1))
    again, cache2 = e.get_or_compute(df, cache, "text", [e.TOY], on_time, model="m")
    assert {r.status for r in again.collect()} == {"hit"} and sorted(r.access_count for r in cache2.collect()) == [2, 4]
    assert {r.status for r in e.get_or_compute(df, cache, "text", [e.TOY], late, model="m")[0].collect()} == {"expired"}
    assert {r.status for r in e.get_or_compute(df, cache, "text", [e.TOY], on_time, model="other")[0].collect()} == {"miss"}
    assert [r.access_count for r in e.maintained(cache2, on_time, 1).collect()] == [4] and e.maintained(cache2, late, 9).count() == 0


def test_search_in_blocks_is_search(spark):
    q = tables.vectors(spark, DATA).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"), "label")
    v = tables.vectors(spark, DATA).unionByName(spark.createDataFrame([(None, [0.5] * 64, 1), (7000, None, 1), (7001, [1.0], 1)], "id long, embedding array<float>, label int"))
    for options in ({"metric": "cosine"}, {"metric": "manhattan", "threshold": 0.05}, {"metric": "dot", "unlike": "label"}):
        whole = {tuple(r) for r in vs.search(q, v, 7, **options).collect()}
        assert {tuple(r) for r in vs.search(q, v, 7, block_bytes=4000, **options).collect()} == whole and whole
    assert vs.search(q.limit(0), v, 7).count() == 0 and vs.search(q, v.limit(0), 7).count() == 0


def test_best_keeps_ties_by_id():
    import pyarrow as pa

    best = vs.Best(pa.table({"id": [1], "v": [[1.0, 0.0]], "code": pa.array([None], pa.int64())}), 2, "cosine", None, 9, False)
    for ids in ([9, 8], [3, 7]):
        best.see(pa.array(ids), pa.array([[2.0, 0.0]] * 2), pa.array([None, None], pa.int64()))
        best.prune()
    (found,) = best.found()
    assert found.column(1).to_pylist() == [3, 7]


def test_best_is_bounded():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    nq, d, k = 3000, 8, 20
    lists = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * d, m.ravel())
    # Few values, so that there are many ties, also across tiles.
    q, x = r.integers(-1, 2, (nq, d)).astype(float), r.integers(-1, 2, (5000, d)).astype(float)
    ids = r.permutation(5000)
    best = vs.Best(pa.table({"id": np.arange(nq), "v": lists(q), "code": pa.nulls(nq, pa.int64())}), k, "euclidean", None, 9, False)
    tracemalloc.start()
    for a in range(0, 5000, 2500):
        best.see(pa.array(ids[a : a + 2500]), lists(x[a : a + 2500]), pa.nulls(2500, pa.int64()))
    found = pa.Table.from_batches(best.found())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20, peak
    got = {}
    for a, i in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        got.setdefault(a, []).append(i)
    for a in range(0, nq, 97):
        s = np.round(vs.similarity("euclidean", x, q[a : a + 1])[:, 0], 9)
        assert got[a] == ids[np.lexsort((ids, -s))][:k].tolist()


def test_errors():
    table = {name: (code, again) for name, code, again in errors.table()}
    assert table["NotFoundError"] == (404, False) and table["AuthenticationError"][0] == 401 and table["AuthorizationError"][0] == 403
    assert table["VectorStoreError"] == (500, True) and table["ModelError"][1] and table["ExternalServiceError"][1] and not table["SearchError"][1]
    assert issubclass(errors.ConfigurationError, errors.EngineError) and table["DocumentError"] == (500, False)
    with pytest.raises(errors.ValidationError, match="ids: from 1 to 100"):
        records.batch_delete(None, "id", list(range(101)))
    with pytest.raises(ValueError):
        records.listed(None, None, limit=1000)


def test_metadata_of_every_format(spark):
    md = '---\nTitle: "A: b"\nauthor: me\ndate: nonsense\ntags: x , y\ncategory: c\nn: 1\nn: 2\n---\n# Other\nbody text'
    html = "<html><head><title> T </title><META NAME='keywords' CONTENT=\"k1,k2\"><meta content=you name=author><meta property='og:x' content='no'></head><body><p>three little words</p></body></html>"
    rows = spark.createDataFrame([(1, md, "MD"), (2, html, "html"), (3, "First line\nand more", "txt"), (4, "# Only\ntext", "md"), (5, None, "md"), (6, "", "html")], "i int, t string, k string")
    m = {r.i: r.m for r in rows.select("i", T.metadata_record(F.col("t"), F.col("k")).alias("m")).collect()}
    assert (m[1].title, m[1].author, m[1].created_date, m[1].tags, m[1].category, m[1].custom_fields) == ("A: b", "me", None, ["x", "y"], "c", {"n": "2"})
    assert (m[2].title, m[2].author, m[2].tags, m[2].custom_fields, m[2].word_count) == ("T", "you", ["k1", "k2"], {}, 4)
    assert m[3].title == "First line" and m[3].word_count == 4 and m[4].title == "Only" and m[4].tags == []
    assert m[6].title is None and m[6].word_count == 0


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda *cols: one.select(*[x.alias(f"c{i}") for i, x in enumerate(cols)]).first()
    s = F.lit
    assert get(Q.add_terms(s("a b"), F.array(s("c"), s("d"))), Q.add_terms(s("a"), F.array().cast("array<string>"))) == ("a b c d", "a")
    assert [x.text for x in get(T.named_entities(s("the New York Times of Paris")))[0]] == ["New York", "York Times"]
    assert get(T.word_pairs(s("one")), T.word_pairs(s("")))[0] == []
    assert get(c.client_limit(s("admin")), c.client_limit(s("other")), c.client_kind(s(None).cast("string"), s(True)), c.client_kind(s("k"), s(None).cast("boolean"))) == (10000, 100, "ip", "key")
    assert get(V.size_issue(F.array(s(1.0)), 2), V.of_size(F.array(s(1.0)), 2), V.size_issue(F.array(s(1.0)), 1)) == ("expected 2 values, found 1", None, None)
    assert get(R.top_factors({"a": s(0.2), "b": s(0.9), "c": s(0.9), "d": s(0.1)}, 3))[0] == ["b: 0.900", "c: 0.900", "a: 0.200"]
    assert get(c.should_log(s("High"), "Medium"), c.should_log(s("Debug"), "Info")) == (True, False)
    assert get(g.client(s(None).cast("string"), s(" 1.2.3.4 , 5.6.7.8"), s("9.9.9.9")), g.client(s(None).cast("string"), s(None).cast("string"), s(None).cast("string"))) == ("1.2.3.4", "unknown")
    with pytest.raises(Exception, match="expected 3 values"):
        one.select(V.same_size(F.array(s(1.0)), 3)).collect()


def test_transitions(spark):
    none = "array<struct<active:boolean,expires_at:timestamp>>"
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "Active", dt.datetime(2023, 1, 1), []), (2, "Active", dt.datetime(2025, 1, 1), [(True, None)]), (3, "DeletionRequested", dt.datetime(2025, 1, 1), []), (4, "DeletionApproved", dt.datetime(2025, 1, 1), []), (5, "LegalHold", dt.datetime(2023, 1, 1), [])]
    r = spark.createDataFrame(rows, f"data_id int, status string, expires_at timestamp, holds {none}")
    for action, want in (
        ("hold", ["LegalHold"] * 5),
        ("release", ["Expired", "Active", "Active", "Active", "Expired"]),
        ("request", ["DeletionRequested", None, "DeletionRequested", "DeletionRequested", "DeletionRequested"]),
        ("approve", [None, None, "DeletionApproved", None, None]),
        ("delete", [None, None, None, "Deleted", None]),
    ):
        acts = spark.createDataFrame([(i, action) for i in range(1, 6)], "data_id int, action string")
        got = {x.data_id: x for x in c.apply_actions(r, acts, F.lit(at), soft=False).collect()}
        assert [None if got[i].rejected else got[i].status for i in range(1, 6)] == want
        assert all(got[i].status == rows[i - 1][1] for i in range(1, 6) if got[i].rejected)
    assert c.apply_actions(r, acts.limit(0), F.lit(at)).where("rejected").count() == 0


def test_prometheus_heads(spark):
    p = spark.createDataFrame([("n", {"b": "1", "a": "2"}, 1.5, dt.datetime(1970, 1, 1, 0, 1)), ("m", {}, 2.0, dt.datetime(1970, 1, 1))], "name string, labels map<string,string>, value double, ts timestamp")
    lines = [r.line for r in g.prometheus(p, {"n": ("gauge", "a number")}).collect()]
    assert lines[:2] == ["# HELP n a number", "# TYPE n gauge"] and set(lines[2:]) == {'n{a="2",b="1"} 1.5 60', "m 2.0 0"}


def test_running_averages_with_nulls(spark):
    rows = [(k, t, v) for k in ("a", "b", None) for t, v in enumerate([1.0, None, 3.0, 5.0, 10.0, None, 2.0])]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.t): r.running_avg for r in g.running_average(df, "v", ["k"], ["t"]).collect()}
    assert got["a", 0] == 1 and got["b", 1] == 1 and got[None, 3] == 3 and got["a", 6] == pytest.approx(21 / 5)
    moved = {(r.k, r.t): r.moving_avg for r in g.moving_average(df, "v", ["k"], ["t"], size=2).collect()}
    assert moved[None, 0] == 1 and moved["a", 3] == 4 and moved["b", 4] == 7.5 and moved["a", 6] == 6
    assert g.running_average(df.limit(0), "v", ["k"], ["t"]).count() == 0


def test_schemas_are_of_use(spark, tmp_path):
    rows = [("1", None, "ErrorOccurred", "7", None, "x", "High", False, 1.0, 2, {"k": "v"})]
    events_ = spark.createDataFrame(rows, schemas.AUDIT_EVENT)
    files.append_jsonl(events_, str(tmp_path / "a"))
    assert files.read_jsonl(spark, str(tmp_path / "a"), schemas.AUDIT_EVENT).first().details == {"k": "v"}
    record = spark.range(1).select(T.record().alias("m")).schema["m"].dataType
    assert {f.name for f in record.fields} - {"title"} <= {f.name for f in schemas.METADATA.fields}


def test_audit_stream(spark, tmp_path):
    stream = events.read_events(spark, f"{DATA}/[e]vents.parquet")
    q = events.append_audit(stream, str(tmp_path / "log"), str(tmp_path / "state"), every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 1000


def test_limiter_stream_is_table(spark, tmp_path):
    ev = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = str(tmp_path / "out")
    write = lambda df, _: df.write.mode("append").parquet(out)
    limited = events.rate_limited(events.read_events(spark, f"{DATA}/[e]vents.parquet"), 5, 86_400)
    q = limited.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", str(tmp_path / "s")).start()
    try:  # state with timeouts keeps such a query busy, so it is stopped once the events are in
        for _ in range(120):
            if q.recentProgress and sum(p["numInputRows"] for p in q.recentProgress) >= 1000:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    got = {r.user_id: r.n for r in spark.read.parquet(out).where("allowed").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert got == {r.user_id: r.allowed for r in g.fixed_window(ev, 5, 86_400).collect()}


def test_new_versions_leave_old_ones(spark, tmp_path):
    one = tables.rewrite(spark.range(3), str(tmp_path / "t"))
    old = spark.read.parquet(one)
    two = tables.rewrite(old.where("id > 0"), str(tmp_path / "t"))
    assert one != two and old.count() == 3 and spark.read.parquet(two).count() == 2


def test_store(spark, tmp_path):
    path = files.save(f"file://{tmp_path}/store", "a.bin", b"\x00\x01")
    assert (tmp_path / "store" / "a.bin").read_bytes() == b"\x00\x01" and files.remove(path) and not files.remove(path)


def test_levels_and_keys(spark):
    now = dt.datetime(2024, 1, 1)
    schema = "key string, value string, size_bytes long, created_at timestamp, expires_at timestamp"
    near = spark.createDataFrame([("a", "1", 1, now, None), ("b", "old", 1, now, now - dt.timedelta(seconds=1))], schema)
    far = spark.createDataFrame([("b", "2", 1, now, None), ("a", "x", 1, now, None)], schema)
    found = caching.look_up(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), near, far, F.lit(now))
    assert {(r.key, r.value, r.level) for r in found.collect()} == {("a", "1", "near"), ("b", "2", "far"), ("c", None, None)}
    (p,) = caching.promoted(found, F.lit(now), 60).collect()
    assert p.key == "b" and p.expires_at == now + dt.timedelta(seconds=60)
    put = caching.put(near, caching.promoted(found, F.lit(now), 60))
    assert {(r.key, r.value) for r in caching.drop(put, found.where("key = 'a'")).collect()} == {("b", "2")}
    keys = spark.createDataFrame([(1, "o", True)], "key_id long, owner string, active boolean")
    assert not c.revoked(keys, keys).first().active
    with pytest.raises(Exception, match="key exists: 1"):
        c.issued(keys, keys.select("key_id", "owner")).collect()


def test_shared_path(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x") and "x-" in shared_path(spark, "x")
