"""The jobs against their SQL, over growing input, and after runs that broke off."""

import datetime as dt
import json
import subprocess
import sys

import pytest
from conftest import DATA, HERE, same
from pyspark.sql import functions as F

from jobs import audit_daily, ingest_documents as ingest, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, duck, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    same(queries.QUERIES[name](spark, DATA), duck, queries.SQL[name])
    assert before == {k: spark.conf.get(k, None) for k in before} and not spark.streams.active


def rows(df):
    return sorted(map(str, df.collect()))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_ingest_grows(spark, tmp_path):
    """New files only are read; what is there stays as it is; a newer version takes the place of the old one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    src, out = tmp_path / "in", tmp_path / "out"
    docs.where("doc_id < 120").repartition(3).write.parquet(str(src))
    assert ingest.run(spark, str(src), str(out)) == 1
    first, before = rows(ingest.current(spark, str(out))), files(out / "documents")
    assert ingest.run(spark, str(src), str(out)) == 0 and files(out / "documents") == before and rows(ingest.current(spark, str(out))) == first
    newer = spark.createDataFrame([(3, "A newer text of document three.", "en"), (5, "short", "en"), (None, "A text that no one can name.", "en"), (900, None, "en"), (901, "The same twice over.", "en"), (901, "The same twice over.", "en"), (902, "One of two texts here.", "en"), (902, "Two of two texts here.", "en")], "doc_id long, text string, lang string")
    docs.where("doc_id >= 120").unionByName(newer).coalesce(1).write.mode("append").parquet(str(src))
    assert ingest.run(spark, str(src), str(out), files_per_batch=1) == 1
    assert all(files(out / "documents")[p] == t for p, t in before.items())
    now = ingest.current(spark, str(out))
    whole = tmp_path / "whole"
    docs.where("doc_id <> 3").write.parquet(str(tmp_path / "all"))
    ingest.run(spark, str(tmp_path / "all"), str(whole), files_per_batch=1)
    assert rows(now.where("document_id <> 3 and document_id < 900")) == rows(ingest.current(spark, str(whole)))
    assert [r.content for r in now.where("document_id = 3").collect()] == ["A newer text of document three."]
    assert now.where("document_id = 5").count() > 0 and now.where("document_id = 901").count() == 1 and now.where("document_id = 902").count() == 1
    bad = {r.document_id: r.reasons for r in ingest.rejected(spark, str(out)).collect()}
    assert bad[5] == "too small" and bad[900] == "empty,too small" and bad[None] == "no id"
    runs = [json.loads(x) for p in (out / "runs").rglob("*.json") for x in p.read_text().splitlines()]
    assert len(runs) == 2 and sum(r["chunks"] for r in runs) == ingest.stored(spark, str(out)).where("chunk_index is not null").count()
    assert sum(r["accepted"] + r["rejected"] for r in runs) == docs.count() + newer.count()


def test_ingest_repeats_a_batch(spark, tmp_path):
    """A batch whose writing broke off leaves no trace when it is run again."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(50).write.parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    # Part of another attempt at batch 0, with a language that this batch hasn't.
    docs.limit(7).selectExpr("doc_id AS document_id", "text AS content", "0 AS chunk_index", "1L AS version", "'accepted' AS status", "'xx' AS language").write.partitionBy("status", "language").parquet(str(out / "documents" / "batch=0"))
    assert ingest.run(spark, str(tmp_path / "in"), str(out)) == 1
    assert ingest.stored(spark, str(out)).where("language = 'xx'").count() == 0
    once = rows(ingest.stored(spark, str(out)))
    ingest.write_batch(docs.limit(50), 0, str(out), {"strategy": "fixed", "size": 1000, "overlap": 200})
    assert rows(ingest.stored(spark, str(out))) == once
    assert ingest.current(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize("strategy", ["paragraph", "sentence", "semantic"])
def test_other_strategies(spark, tmp_path, strategy):
    """The strategy alone may change in a config file that names all settings."""
    docs = spark.createDataFrame([(1, "One sentence here. Another sentence there! " * 30), (2, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    assert ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), strategy=strategy, size=300, overlap=50) == 1
    got = ingest.current(spark, str(tmp_path / "out"))
    assert got.count() >= 1 and {r.document_id for r in got.collect()} == {1}
    if strategy == "sentence":
        assert got.agg(F.max(F.length("content"))).first()[0] <= 300 and got.count() > 3


def test_audit_grows(spark, duck, tmp_path):
    """Only what is above the mark is read; days that late events touch are reported anew, others aren't."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    n = events.count()
    src, out = str(tmp_path / "in"), tmp_path / "out"
    early = events.where("ts < '2024-01-15'")
    early.write.parquet(src)
    assert audit_daily.run(spark, src, str(out)) == early.count()
    before = files(out / "daily")
    assert audit_daily.run(spark, src, str(out)) == 0 and files(out / "daily") == before
    late = spark.createDataFrame([(n + 10, dt.datetime(2024, 1, 3, 5), 1, "error", 2.0, '{"k": 7}'), (n + 11, None, None, None, None, "no json"), (None, dt.datetime(2024, 1, 3), 1, "view", 1.0, None)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.where("ts >= '2024-01-15'").unionByName(late).write.mode("append").parquet(src)
    assert audit_daily.run(spark, src, str(out)) == n - early.count() + 2
    after = files(out / "daily")
    same_days = {p for p, t in before.items() if after.get(p) == t}
    assert any("day=2024-01-02" in p for p in same_days) and not any("day=2024-01-03" in p for p in same_days)
    duck.execute("CREATE OR REPLACE TABLE grown AS SELECT * FROM read_parquet(?) WHERE event_id IS NOT NULL", [f"{src}/*.parquet"])
    sql = queries.SQL["job2_audit_daily"].replace("FROM events", "FROM grown").replace("json_extract_string(props, '$.k')", "CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END")
    same(audit_daily.daily(spark, str(out)).withColumn("day", F.col("day").cast("string")), duck, sql)


def test_audit_repeats_a_load(spark, tmp_path):
    """A run that broke off before its mark is done again, with what has come since."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    src, out, other = str(tmp_path / "in"), tmp_path / "out", tmp_path / "other"
    events.where("event_id < 300").write.parquet(src)
    audit_daily.run(spark, src, str(out))
    for p in (out / "marks").rglob("*"):
        if p.is_file():
            p.unlink()
    for p in sorted((out / "marks").rglob("*"), reverse=True):
        p.rmdir()
    (out / "marks").rmdir()
    events.where("event_id between 300 and 600").write.mode("append").parquet(src)
    assert audit_daily.run(spark, src, str(out)) == 601
    audit_daily.run(spark, src, str(other))
    assert rows(audit_daily.daily(spark, str(out))) == rows(audit_daily.daily(spark, str(other)))
    assert audit_daily._table(spark, f"{out}/audit", audit_daily.AUDIT).count() == 601


def test_command_lines(tmp_path):
    """Each job as it is started, from its config file, twice."""
    for name, table, result in (("ingest_documents", "documents", "documents"), ("audit_daily", "events", "daily")):
        src = tmp_path / f"{name}-in"
        src.mkdir()
        (src / "a.parquet").write_bytes(open(f"{DATA}/{table}.parquet", "rb").read())
        call = [sys.executable, f"{HERE}/jobs/{name}.py", "--config", f"{HERE}/jobs/{name}.toml", "--source", str(src), "--target", str(tmp_path / name), "--master", "local[2]"]
        for again in (False, True):
            done = subprocess.run(call, capture_output=True, text=True, timeout=240, cwd=tmp_path)
            assert done.returncode == 0, done.stderr[-2000:]
            assert ("0 new batches" in done.stderr or "nothing above" in done.stderr) == again
        assert list((tmp_path / name / result).rglob("*.parquet"))


def test_apart():
    """Jobs know nothing of the training-data operators."""
    for name in ("ingest_documents", "audit_daily", "queries", "__init__"):
        text = open(f"{HERE}/jobs/{name}.py").read()
        assert "llm" not in text and "corpus_pipeline" not in text
