"""The jobs over the test tables, each run twice into one folder, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusql.catalogue import governance as G
from corpusql.catalogue import text as X
from corpusql.session import shared_path
from jobs import audit_daily, ingest_documents


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_path(spark, "job1")
    for _ in range(2):
        # As a glob: the table is one file or a folder of files.
        ingest_documents.run(spark, f"{sf_dir}/documents.parque[t]", target)
    chunks = ingest_documents.current(spark, target)
    return chunks.withColumn("reasons", F.lit(None).cast("string")).unionByName(ingest_documents.rejected(spark, target), allowMissingColumns=True)


def job2_audit_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_path(spark, "job2")
    for _ in range(2):
        audit_daily.run(spark, f"{sf_dir}/events.parquet", target)
    return audit_daily.daily(spark, target).withColumn("day", F.col("day").cast("string"))


_INGEST = f"""WITH d AS (SELECT doc_id, {X._ERRORS} AS e, {X._sanitise_sql()} AS clean FROM documents),
    r AS (SELECT doc_id, clean, CASE WHEN len(e) = 0 AND clean = '' THEN ['no text'] ELSE e END AS e FROM d),
    n AS (SELECT doc_id, clean, {X._count(X.lexicon.LANGUAGES['en'])} AS en, {X._count(X.lexicon.LANGUAGES['es'])} AS es, {X._count(X.lexicon.LANGUAGES['fr'])} AS fr FROM (SELECT *, lower(substring(clean, 1, 1000)) AS s FROM r WHERE len(e) = 0)),
    c AS (SELECT doc_id AS document_id, CAST(i AS INTEGER) AS chunk_index, CASE WHEN en > es AND en > fr THEN 'en' WHEN es > fr THEN 'es' WHEN fr > 0 THEN 'fr' ELSE 'unknown' END AS language, substring(clean, i * 800 + 1, 1000) AS content
          FROM (SELECT *, unnest(range(0, CAST(ceil(length(clean) / 800) AS BIGINT))) AS i FROM n))
    SELECT document_id, chunk_index, language, CAST(len({X._W.format('content')}) AS BIGINT) AS words, content, NULL AS reasons FROM c
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, array_to_string(e, ',') FROM r WHERE len(e) > 0"""


def _day(kind: str, column: str) -> str:
    return f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, '{kind}' AS kind, {column} AS name, count(*) AS n, count(*) FILTER (NOT success) AS failed, round(avg(duration_ms), 6) AS avg_duration, CAST(coalesce(sum(data_size), 0) AS BIGINT) AS bytes FROM a GROUP BY CAST(ts AS DATE)" + ("" if column == "''" else f", {column}")


_DAILY = f"""WITH {G._AUDIT}, u AS ({_day('user_id', 'user_id')}), top AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, name) AS r FROM u)
    {_day('all', "''")} UNION ALL {_day('event_type', 'event_type')} UNION ALL {_day('severity', 'severity')} UNION ALL SELECT * EXCLUDE (r) FROM top WHERE r <= 10"""

QUERIES = {"job1_ingest_documents": job1_ingest_documents, "job2_audit_daily": job2_audit_daily}
SQL = {"job1_ingest_documents": _INGEST, "job2_audit_daily": _DAILY}
