"""Reading files by type, tables, and streams that give what the tables give."""

import io
import zipfile

from conftest import DATA
from pyspark.sql import functions as F

from corpusql.sources import files, tables
from corpusql.streaming import events


def test_files(spark, tmp_path):
    def docx(*lines):
        b = io.BytesIO()
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(f'<w:p><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)}</w:body></w:document>")
        return b.getvalue()

    for name, content in {
        "a.txt": "café first line\nmore".encode(),
        "b.md": b"# Title here\n\n* item **bold**",
        "c.html": b"<html><head><title>Page</title><script>x()</script></head><body><p>Hello <b>you</b></p></body></html>",
        "d.rtf": rb"{\rtf1 \b Hello}",
        "e.docx": docx("one", "two"),
        "f.pdf": b"%PDF",
        "g.docx": b"broken",
        "h.txt": "naïve".encode("windows-1252"),
        "i.txt": b" \n ",
    }.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path[-6:].strip("/").rsplit("/", 1)[-1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text.startswith("café") and got["h.txt"].text == "naïve" and got["i.txt"].status == "empty"
    assert got["b.md"].title == "Title here" and "bold" in got["b.md"].text and "*" not in got["b.md"].text
    assert got["c.html"].title == "Page" and got["c.html"].text == "Page Hello you"
    assert "Hello" in got["d.rtf"].text and got["e.docx"].text == "one\ntwo"
    assert got["f.pdf"].status == "unreadable" and got["g.docx"].status == "empty"


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in tables.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert tables.delete(old, new, "k").collect()[0].k == 1
    files.append_jsonl(old, str(tmp_path / "j"))
    files.append_jsonl(new, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "k long, v string").count() == 4


def test_stream_is_batch(spark, tmp_path):
    stream = events.read_events(spark, f"{DATA}/[e]vents.parquet")
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, f in (("t1", events.tumbling), ("t2", events.sliding)):
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(batch).collect()))
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()
