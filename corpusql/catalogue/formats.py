"""Formats, file ingest, request options and metrics that are taken on the way, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.catalogue import search as S
from corpusql.catalogue import text as X
from corpusql.functions import lexicon
from corpusql.functions import query_text as Q
from corpusql.functions import text as T
from corpusql.functions import validation as V
from corpusql.operators import governance as g, vector_search as vs
from corpusql.plans import answer as plan
from corpusql.session import shared_path
from corpusql.sources import tables as t
from corpusql.streaming import ingest as si

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LATIN = "regexp_replace(text, '[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]', '?', 'g')"


@query(
    f"""SELECT doc_id, sha256(text) AS utf8, sha256({_LATIN} || '€“”') AS latin, (length(text) - length(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g')) + doc_id % 40) / greatest(strlen(text) + doc_id % 40, 1) < 0.05 AS likely FROM documents"""
)
def format_decode(spark, base):
    """Texts encoded as UTF-8 and as windows-1252, and which they are found to be; whether texts with more and more control characters are texts."""
    d = t.read(spark, base, "documents").select("doc_id", "text")
    latin = F.concat(F.encode(F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", "?"), "ISO-8859-1"), F.unhex(F.lit("809394")))
    noisy = F.concat("text", F.repeat(F.lit("\x01"), F.pmod("doc_id", F.lit(40)).cast("int")))
    return d.select("doc_id", F.sha2(T.decode(F.encode("text", "UTF-8")), 256).alias("utf8"), F.sha2(T.decode(latin), 256).alias("latin"), T.likely_text(noisy).alias("likely"))


_MD = "'# Title ' || doc_id || chr(10) || chr(10) || '* **bold** item' || chr(10) || '[a link](http://x) ![p](y.png) ' || chr(96) || 'code' || chr(96) || ' ' || replace(text, chr(13), '')"
_MD_TEXT = _MD
for _p, _to in ((r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", r"\1")):
    _MD_TEXT = f"regexp_replace({_MD_TEXT}, '{_p}', '{_to}', 'g')"
_RTF = "'{\\rtf1\\ansi ' || text || '\\par }'"


@query(rf"SELECT doc_id, 'Title ' || doc_id AS title, sha256({_MD_TEXT}) AS markdown, sha256(regexp_replace(regexp_replace({_RTF}, '\\[^\s]*', '', 'g'), '[{{}}]', '', 'g')) AS rtf FROM documents")
def format_markup(spark, base):
    """Texts as Markdown and as RTF, and what is left of them."""
    d = t.read(spark, base, "documents").select("doc_id", "text")
    md = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n* **bold** item\n[a link](http://x) ![p](y.png) `code` "), F.replace("text", F.lit("\r"), F.lit("")))
    rtf = F.concat(F.lit("{\\rtf1\\ansi "), "text", F.lit("\\par }"))
    return d.select("doc_id", T.markdown_title(md).alias("title"), F.sha2(T.markdown_text(md), 256).alias("markdown"), F.sha2(T.rtf_text(rtf), 256).alias("rtf"))


@query(
    """SELECT doc_id, try_strptime(substr('D:' || d, 3, 14), '%Y%m%d%H%M%S') AS made, CASE WHEN length(text) <= 100 THEN text ELSE coalesce(nullif(regexp_extract(substring(text, 1, 100), '(?s)^(.*) [^ ]*$', 1), ''), substring(text, 1, 100)) END AS head
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '20241399000000' ELSE '2024' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '101500+01''00''' END AS d FROM documents)"""
)
def text_helpers(spark, base):
    """Dates as PDF files write them, some of which are none; texts cut at a space."""
    two = lambda n: F.lpad((F.pmod("doc_id", F.lit(n)) + 1).cast("string"), 2, "0")
    date = F.when(F.col("doc_id") % 5 == 0, "D:20241399000000").otherwise(F.concat(F.lit("D:2024"), two(12), two(28), F.lit("101500+01'00'")))
    return t.read(spark, base, "documents").select("doc_id", T.pdf_date(date).cast("timestamp_ntz").alias("made"), T.truncate(F.col("text"), 100).alias("head"))


_ASKED = "CASE turn % 4 WHEN 0 THEN 'not error ' || text WHEN 2 THEN 'without problem here ' || text ELSE text END"


@query(
    rf"""WITH u AS (SELECT conv_id, turn, {_ASKED} AS text, chr(7) || text || chr(9) || ' end ' || chr(31) AS raw FROM conversations WHERE role = 'user'), n AS (SELECT *, {X._negations('text')} AS neg FROM u)
    SELECT conv_id, turn, trim(regexp_replace(replace(replace(text, 'error', CASE WHEN len(list_filter(neg, lambda x: suffix(x, ':success'))) > 0 THEN 'success' ELSE 'error' END), 'problem', CASE WHEN len(list_filter(neg, lambda x: suffix(x, ':solution'))) > 0 THEN 'solution' ELSE 'problem' END), '\s+', ' ', 'g')) AS positive,
    trim(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')) AS sanitised FROM n"""
)
def query_rephrased(spark, base):
    """Queries with negated errors and problems put the other way, and queries with control characters cleaned."""
    x = F.col("text")
    asked = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("not error "), x)).when(F.col("turn") % 4 == 2, F.concat(F.lit("without problem here "), x)).otherwise(x)
    raw = F.concat(F.lit("\x07"), x, F.lit("\t end \x1f"))
    return t.read(spark, base, "conversations").where("role = 'user'").select("conv_id", "turn", Q.without_negations(asked).alias("positive"), Q.sanitised(raw).alias("sanitised"))


_ON = {"synonyms": 2, "semantic": 3, "domain": 5, "negation": 7, "refinement": 11}


def _option(name: str) -> str:
    """The value that a row's option comes to: by its numbers set to true, set to false, or not set."""
    return f"((conv_id + turn) % {_ON[name]} <> 1)"


_TEXT = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'fast api algoritm not error ' || text WHEN 1 THEN 'big database ML python docker ' || text ELSE text END"


def _some(*tables) -> str:
    x = X._expanded(*tables)
    return f"list_slice(list_filter({x}, lambda v, i: list_position({x}, v) = i), 1, m)"


@query(
    rf"""WITH u AS (SELECT conv_id, turn, {_TEXT} AS text, CASE WHEN turn % 2 = 0 THEN 10 ELSE 3 END AS m FROM conversations WHERE role = 'user'), n AS (SELECT *, {X._negations('text')} AS neg FROM u),
    p AS (SELECT *, CASE WHEN {_option('negation')} THEN trim(regexp_replace(replace(replace(text, 'error', CASE WHEN len(list_filter(neg, lambda x: suffix(x, ':success'))) > 0 THEN 'success' ELSE 'error' END), 'problem', CASE WHEN len(list_filter(neg, lambda x: suffix(x, ':solution'))) > 0 THEN 'solution' ELSE 'problem' END), '\s+', ' ', 'g')) ELSE text END AS y FROM n),
    r AS (SELECT *, CASE WHEN {_option('refinement')} THEN {X._replaced(X._replaced('y', lexicon.SPELLINGS, '{v}'), lexicon.ACRONYMS, '{k} {v}')} ELSE y END AS refined FROM p),
    w AS (SELECT *, {X._W.format('lower(refined)')} AS w FROM r),
    e AS (SELECT *, CASE WHEN {_option('synonyms')} THEN {_some(lexicon.GENERAL_SYNONYMS, lexicon.TECHNICAL_SYNONYMS)} ELSE [] END AS a, CASE WHEN {_option('semantic')} THEN {_some(lexicon.HYPERNYMS, lexicon.RELATED)} ELSE [] END AS b, CASE WHEN {_option('domain')} THEN {_some(lexicon.DOMAIN, lexicon.HIERARCHIES)} ELSE [] END AS c FROM w)
    SELECT conv_id, turn, refined, array_to_string(a, ',') AS synonyms, array_to_string(b, ',') AS semantic, array_to_string(c, ',') AS domain, trim(text || ' ' || array_to_string(list_concat(list_concat(a, b), c), ' ')) AS query FROM e"""
)
def expansion_options(spark, base):
    """Expansion with each request's own options, part of which it leaves to the defaults."""
    k = F.col("conv_id") + F.col("turn")
    x = F.col("text")
    x = F.when(k % 3 == 0, F.concat(F.lit("fast api algoritm not error "), x)).when(k % 3 == 1, F.concat(F.lit("big database ML python docker "), x)).otherwise(x)
    # Set to false, set to true, or not set.
    options = {name: F.when(k % n == 1, False).when(k % n == 0, True) for name, n in _ON.items()}
    e = Q.expanded(x, most=F.when(F.col("turn") % 2 == 1, 3), **options)
    r = t.read(spark, base, "conversations").where("role = 'user'").select("conv_id", "turn", e.alias("e"))
    return r.select("conv_id", "turn", "e.refined", *[F.array_join(f"e.{c}", ",").alias(c) for c in ("synonyms", "semantic", "domain")], "e.query")


_EXT = "CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'TXT' WHEN 2 THEN 'exe' WHEN 3 THEN 'html' WHEN 4 THEN '' ELSE 'md' END"


@query(f"SELECT doc_id, array_to_string(list_concat({X._ERRORS}, CASE WHEN lower({_EXT}) IN ('pdf', 'txt', 'md', 'docx', 'html', 'htm', 'rtf') THEN [] ELSE ['file type'] END), ',') AS errors FROM documents")
def validate_file_types(spark, base):
    d = t.read(spark, base, "documents").select("doc_id", "text", F.expr(_EXT).alias("ext"))
    return d.select("doc_id", F.array_join(V.errors(F.col("text"), F.col("ext")), ",").alias("errors"))


@query(f"WITH {S._DOCS} SELECT id FROM docs WHERE id % 7 BETWEEN 1 AND 3 AND created_at <= TIMESTAMP '2024-06-30' AND id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def filter_ranges(spark, base):
    """Chunks of the documents that a table names, by place and latest date."""
    import datetime as dt

    chunks = t.documents(spark, base).withColumn("chunk_index", F.pmod("id", F.lit(7)))
    good = t.read(spark, base, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return vs.of_documents(chunks, good).where(vs.filters(chunk_index=(1, 3), created_before=dt.datetime(2024, 6, 30))).select("id")


@query(
    S._hybrid_sql(
        S._CONF
        + """, z9 AS (SELECT qs.query_id, coalesce(n_chunks, 0) AS n, coalesce(confidence, 0) AS c FROM qs LEFT JOIN cf ON qs.query_id = cf.query_id),
        v AS (SELECT unnest(['queries', 'answered', 'chunks', 'confidence']) AS name, unnest([count(*)::DOUBLE, (count(*) FILTER (n > 0))::DOUBLE, sum(n)::DOUBLE, round(avg(c), 6)]) AS value FROM z9)
        SELECT name, round(value, 6) AS value FROM v"""
    )
)
def metrics_observed(spark, base):
    """Counters of a batch of answers, taken while it is written and not by reading it again."""
    q, d, v = S._inputs(spark, base)
    rows, seen = g.counted(plan.answer(q, d, v), "answers", queries=F.count("*"), answered=F.count_if(F.col("n_chunks") > 0), chunks=F.sum("n_chunks"), confidence=F.round(F.avg("confidence"), 6))
    rows.write.parquet(shared_path(spark, "answers"))
    points = g.counted_points(spark, seen, {"plan": "answer"}, F.lit(t.AS_OF).cast("timestamp"))
    return points.select("name", F.round("value", 6).alias("value"))


@query(
    f"""WITH g AS (SELECT doc_id // 250 AS k, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1), e AS (SELECT k, text, {X._ERRORS} AS e FROM g)
    SELECT k, sha256(text) AS hash, strlen(text) AS bytes, CASE WHEN len(e) = 0 THEN 'ok' ELSE array_to_string(e, ',') END AS status FROM e"""
)
def ingest_file_stream(spark, base):
    """Files that the documents are written to, taken by a stream, ten at a time; run twice."""
    path = shared_path(spark, "files")
    d = t.read(spark, base, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 250).alias("k"))
    d.repartition("k").sortWithinPartitions("k", "doc_id").select("text", "k").write.partitionBy("k").text(f"{path}/in")
    for _ in range(2):
        si.ingest_files(spark, f"{path}/in", f"{path}/out")
    number = F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("k")
    columns = [number, "hash", F.col("file_size").alias("bytes")]
    good = si.documents(spark, f"{path}/out").select("hash", "path", "file_size").unionByName(si.copies(spark, f"{path}/out").select("hash", "path", "file_size"))
    return good.select(*columns, F.lit("ok").alias("status")).unionByName(si.rejected(spark, f"{path}/out").select(*columns, "status"))
