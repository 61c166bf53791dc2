"""Files taken by a stream, options of a request, and counters taken on the way."""

import duckdb
import pytest
from conftest import same
from pyspark.sql import functions as F

from corpusql.catalogue import formats
from corpusql.functions import query_text as Q
from corpusql.operators import governance as g
from corpusql.operators import vector_search as vs
from corpusql.sources import buckets, files
from corpusql.streaming import ingest as si


def documents(spark, out):
    return sorted((r.path.rsplit("/", 1)[1], r.text, r.language) for r in buckets.read(spark, f"{out}/documents", si.DOCUMENTS).collect())


def test_files_come_one_by_one(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "deep").mkdir(parents=True)
    text = "the first of many files that are in this folder"
    (src / "a.txt").write_text(text)
    (src / "b.md").write_text("# A title\n\n**bold** words that say something")
    (src / "bad.txt").write_text("short")
    (src / "x.html").write_bytes(b"<html><body onload=go()>javascript: <p>here</p></body></html>")
    (src / "deep" / "f.pdf").write_bytes(b"%PDF-1.4 nothing")
    assert si.ingest_files(spark, str(src), out, files_a_batch=2) == 3
    first = documents(spark, out)
    # What the reader of a folder finds to be fit, but for the content checks.
    plain = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(src)).collect()}
    assert [x[:2] for x in first if x[0] != "x.html"] == sorted((n, plain[n].text) for n in ("a.txt", "b.md"))
    why = {r.path.rsplit("/", 1)[1]: r.status for r in si.rejected(spark, out).collect()}
    assert why["bad.txt"] == "too small" and why["f.pdf"] == "unreadable"
    assert si.ingest_files(spark, str(src), out) == 0 and documents(spark, out) == first
    (src / "again.txt").write_text(text)  # the same content by another name
    (src / "new.txt").write_text("el texto que se lee en un folio de papel")
    assert si.ingest_files(spark, str(src), out) == 1
    assert documents(spark, out) == sorted([*first, ("new.txt", "el texto que se lee en un folio de papel", "es")])
    # A batch that is taken again changes nothing.
    batch = spark.read.format("binaryFile").load([str(src / "new.txt"), str(src / "bad.txt")])
    before = documents(spark, out), si.rejected(spark, out).count()
    for _ in range(2):
        si.take(batch, 99, out, 50 << 20, None, 16)
        assert documents(spark, out) == before[0] and si.rejected(spark, out).count() == before[1] + 1
    assert si.rejected(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_rewrites_no_other(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i in range(6):
        (src / f"f{i}.txt").write_text(f"text number {i // 2} of several that are the same in pairs")
    assert si.ingest_files(spark, str(src), str(out), files_a_batch=3) == 2
    written = {p: p.stat().st_mtime_ns for p in (out / "documents").rglob("*.parquet")}
    # The pair that lies in two batches is a document once.
    assert sorted(r.text[12] for r in buckets.read(spark, str(out / "documents"), si.DOCUMENTS).collect()) == ["0", "1", "2"]
    (src / "more.txt").write_text("a text that comes later than all of them")
    assert si.ingest_files(spark, str(src), str(out)) == 1
    assert {p: p.stat().st_mtime_ns for p in written if p.exists()} == written
    # Of what is staged only the last batch is there.
    assert [p.name for p in out.iterdir() if p.name.startswith(("batches", "documents.staged"))] == []
    assert spark.read.parquet(str(out / "staged")).count() == 1


def test_hashes_of_other_batches(spark, tmp_path, monkeypatch):
    """What a batch reads to know the others grows with the logarithm of their number, and it knows all."""
    out, n = str(tmp_path / "out"), 12
    known, read = si.known, []
    monkeypatch.setattr(si, "SPAN", 2)
    monkeypatch.setattr(si, "known", lambda *a: read.append((a[2], known(*a))) or read[-1][1])

    def rows(number, of):
        one = [(f"h{k}", f"/in/{number}-{k}.txt", "txt", 1, "t", f"text {k}", "en", "ok" if k % 10 else "empty") for k in of]
        return spark.createDataFrame(one, f"{si.DOCUMENTS}, status string").coalesce(1)

    # A new text, one that was bad, one of the batch before and one of the first batch.
    for b in range(n):
        si.store(rows(b, [b + 1000, 10 * b, max(b + 999, 1000), 1000]), b, out, 2)
        # Taking a batch again changes nothing, also where it ends a span.
        if b in (0, 3, 8, n - 1):
            si.store(rows(b, [b + 1000, 10 * b, max(b + 999, 1000), 1000]), b, out, 2)
    want = sorted((f"h{b + 1000}", b) for b in range(n) if (b + 1000) % 10)
    assert sorted((r.hash, r.batch) for r in si.documents(spark, out).collect()) == want
    last = [df for number, df in read if number == n - 1][0]
    parents = {f.rsplit("/", 2)[1] for f in last.inputFiles()}
    assert parents == {"batch=10", "5", "4"}
    assert sorted(r.hash for r in last.collect()) == sorted(h for h, b in want if b < n - 1)
    # A table without the hashes, as it was written before, is read itself.
    old = str(tmp_path / "old")
    with monkeypatch.context() as m:
        m.setattr(si, "_end_span", lambda *a: None)
        for b in range(5):
            si.store(rows(b, [b + 1001]), b, old, 2)
    for b in range(5, 8):
        si.store(rows(b, [1001, 1005]), b, old, 2)
    assert sorted((r.hash, r.batch) for r in si.documents(spark, old).collect()) == [(f"h{b + 1001}", b) for b in range(5)]
    assert sorted(r.hash for r in spark.read.parquet(f"{old}/hashes/4").collect()) == [f"h{b + 1001}" for b in range(5)]
    # A batch that is taken again by other limits leaves no rejected row behind.
    si.store(rows(3, [30]), 3, out, 2)
    si.store(rows(3, [1003]), 3, out, 2)
    assert si.rejected(spark, out).where("hash = 'h30'").count() == 0


def test_files_of_the_same_content_are_rows_too(spark, tmp_path):
    """As in larger tables that repeat the documents with shifted keys."""
    table = str(tmp_path / "documents.parquet")
    d = spark.createDataFrame([(i, f"text number {i} of some") for i in range(20)], "doc_id long, text string")
    spark.range(12).withColumnRenamed("id", "n").crossJoin(d).select((F.col("doc_id") + 250 * F.col("n")).alias("doc_id"), "text").write.parquet(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{table}/*.parquet'")
    same(formats.ingest_file_stream(spark, str(tmp_path)), con, formats.SQL["ingest_file_stream"])


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.txt").write_text("many words " * 100)
    (tmp_path / "in" / "fits.txt").write_text("some words that fit")
    si.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), most_bytes=100)
    assert [(r.status, r.file_size) for r in si.rejected(spark, str(tmp_path / "out")).collect()] == [("size", 1100)]


def test_expansion_options(spark):
    rows = [("fast api error", None, None), ("fast api error", False, 1), ("not error here", None, None), (None, None, None), ("", None, None)]
    df = spark.createDataFrame(rows, "t string, on boolean, n int")
    e = [r.e for r in df.select(Q.expanded(F.col("t"), synonyms=F.col("on"), most=F.col("n")).alias("e")).collect()]
    assert e[0].synonyms[:3] == ["quick", "rapid", "speedy"] and e[0].query.startswith("fast api error quick rapid speedy") and e[0].semantic == ["rest", "graphql", "endpoint"]
    assert e[1].synonyms == [] and e[1].semantic == ["rest"] and e[1].query == "fast api error rest"
    assert e[2].refined == "not success here" and e[4].query == ""
    off = df.where("t like 'not%'").select(Q.expanded(F.col("t"), negation=F.lit(False)).alias("e")).first().e
    assert off.refined == "not error here" and "exception" in off.synonyms
    with pytest.raises(ValueError):
        Q.expanded(F.col("t"), colour=F.lit(True))
    assert spark.range(1).select(Q.sanitised(F.lit("\x00 a\x07b \t\n c\x9f "))).first()[0] == "ab c"


def test_counted(spark, tmp_path):
    df, seen = g.counted(spark.range(100).withColumn("v", F.col("id") % 7), "rows", n=F.count("*"), top=F.max("v"), none=F.max(F.lit(None).cast("double")))
    df.where("v = 3").write.parquet(str(tmp_path / "t"))
    points = {r.name: (r.value, r.labels) for r in g.counted_points(spark, seen, {"a": "b"}, F.current_timestamp()).collect()}
    assert points == {"n": (100.0, {"a": "b"}), "top": (6.0, {"a": "b"}), "none": (None, {"a": "b"})}
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None)], "id long, document_id long")
    wanted = spark.createDataFrame([(10,), (10,), (12,), (None,)], "document_id long")
    assert sorted(r.id for r in vs.of_documents(chunks, wanted).collect()) == [1, 2]
