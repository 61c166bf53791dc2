"""The functions by name in SQL, on awkward values."""

from corpusql import sqlfunctions
from corpusql.functions import text as T
from corpusql.operators import chunking
from pyspark.sql import functions as F


def test_table_functions(spark):
    sqlfunctions.register(spark)
    rows = [(1, '---\ntitle: "A: b"\nno entry\n x : y:z \n---\nbody'), (2, "no head\n---\na: b\n---\n"), (3, ""), (4, None), (5, "---\n---\n"), (6, "abcdefghij")]
    spark.createDataFrame(rows, "id long, t string").createOrReplaceTempView("cq_heads")
    got = [(r.id, r.name, r.value) for r in spark.sql("SELECT id, f.name, f.value FROM cq_heads, LATERAL cq_front_matter(t) f").collect()]
    assert got == [(1, "title", "A: b"), (1, "x", "y:z")]
    # The same entries as the expression gives.
    maps = {r.id: r.m for r in spark.table("cq_heads").select("id", T.front_matter(F.col("t")).alias("m")).collect()}
    assert maps[1] == dict(x[1:] for x in got) and not maps[2]
    parts = [(r.chunk_index, r.start, r.content) for r in spark.sql("SELECT c.* FROM cq_heads, LATERAL cq_chunk_rows(t, 4, 1) c WHERE id = 6").collect()]
    assert parts == [(0, 0, "abcd"), (1, 3, "defg"), (2, 6, "ghij"), (3, 9, "j")]
    assert spark.sql("SELECT * FROM cq_heads, LATERAL cq_chunk_rows(t, 4, 1) WHERE id IN (3, 4)").count() == 0


def test_arrays_of_table_functions(spark):
    """Unfolded, they are the rows of the table functions; the query over documents has no exchange."""
    from conftest import DATA
    from corpusql.catalogue import service

    sqlfunctions.register(spark)
    rows = [(1, '---\ntitle: "A: b"\nno entry\n x : y:z \n---\nbody'), (2, "no head\n---\na: b\n---\n"), (3, ""), (4, None), (5, "---\n---\n"), (6, "abcdefghij")]
    spark.createDataFrame(rows, "id long, t string").createOrReplaceTempView("cq_heads")
    for array, table in (("cq_front_entries(t)", "cq_front_matter(t)"), ("cq_chunk_places(t, 4, 1)", "cq_chunk_rows(t, 4, 1)")):
        got = spark.sql(f"SELECT id, f.* FROM (SELECT id, {array} AS a FROM cq_heads) LATERAL VIEW inline(a) f").collect()
        want = spark.sql(f"SELECT id, f.* FROM cq_heads, LATERAL {table} f").collect()
        assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
    plan = service.sql_table_functions(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_contexts(spark):
    sqlfunctions.register(spark)
    rows = [(1, 2, "cc"), (1, 0, "aaaa"), (1, 1, "b" * 30), (1, 3, None), (2, 0, "x"), (None, 0, "n"), (None, 1, "m")]
    spark.createDataFrame(rows, "document_id long, chunk_index int, content string").repartition(3).createOrReplaceTempView("cq_rows")
    sql = "SELECT * FROM cq_contexts(TABLE(SELECT * FROM cq_rows{}) PARTITION BY (document_id) ORDER BY (chunk_index), 10)"
    got = sorted((r.document_id or 0, r.context, r.first, r.last, r.content) for r in spark.sql(sql.format("")).collect())
    assert got == [(0, 0, 0, 1, "n\n\nm"), (1, 0, 0, 0, "aaaa"), (1, 1, 1, 1, "b" * 30), (1, 2, 2, 3, "cc\n\n"), (2, 0, 0, 0, "x")]
    assert spark.sql(sql.format(" WHERE false")).count() == 0
    # Contexts hold every chunk once, in order.
    d = spark.createDataFrame([(i, "word " * (i * 7)) for i in range(1, 40)], "doc_id long, text string")
    chunking.chunks(d, "fixed", size=20, overlap=3).createOrReplaceTempView("cq_rows")
    n = spark.sql(sql.format("").replace(", 10)", ", 50)")).agg(F.sum(F.col("last") - F.col("first") + 1), F.max(F.length("content"))).first()
    assert n[0] == spark.table("cq_rows").count() and n[1] <= 50
