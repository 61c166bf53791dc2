"""Validation, cleaning, metadata, chunking and query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusql.functions import lexicon
from corpusql.functions import crypto
from corpusql.functions import query_text as Q
from corpusql.functions import text as T
from corpusql.functions import validation as V
from corpusql.operators import chunking
from corpusql.plans import ingest
from corpusql.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, base):
    return t.read(spark, base, "documents").select("doc_id", "text", "lang", "source")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_ERRORS = f"""list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN strlen(text) < 10 THEN 'too small' END, CASE WHEN strlen(text) > 10485760 THEN 'too large' END,
    CASE WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, '{_CONTROL}', '', 'g'))) / length(text) > 0.1 THEN 'control characters' END,
    {", ".join(f"CASE WHEN regexp_matches(text, {_lit(p)}) THEN 'blocked {i}' END" for i, p in enumerate(lexicon.BLOCKED))}], lambda x: x IS NOT NULL)"""


@query(f"SELECT doc_id, array_to_string({_ERRORS}, ',') AS errors FROM documents")
def validate_errors(spark, base):
    return _docs(spark, base).select("doc_id", F.array_join(V.errors(F.col("text")), ",").alias("errors"))


_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_lit(p)}) THEN {i} END" for i, p in enumerate(lexicon.SENSITIVE)) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_HITS}, ',') AS sensitive, CAST(len(list_filter(string_split(text, chr(10)), lambda x: strlen(x) > 10000)) AS BIGINT) AS long_lines FROM documents")
def validate_warnings(spark, base):
    hits = F.transform(V.sensitive_hits(F.col("text")), lambda x: x.cast("string"))
    return _docs(spark, base).select("doc_id", F.array_join(hits, ",").alias("sensitive"), V.long_lines(F.col("text")).alias("long_lines"))


def _sanitise_sql() -> str:
    x = rf"trim(regexp_replace(regexp_replace(text, '{_CONTROL}', '', 'g'), '\s+', ' ', 'g'))"
    for p in lexicon.SENSITIVE:
        x = f"regexp_replace({x}, {_lit(p)}, '[REDACTED]', 'g')"
    for p in lexicon.BLOCKED:
        x = f"regexp_replace({x}, {_lit(p)}, '[REMOVED]', 'g')"
    return x


@query(f"SELECT doc_id, {_sanitise_sql()} AS sanitised FROM documents")
def sanitize_redact(spark, base):
    return _docs(spark, base).select("doc_id", V.sanitise(F.col("text")).alias("sanitised"))


_W = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
_QUALITY = rf"""WITH w AS (SELECT doc_id, text, {_W.format('lower(text)')} AS w FROM documents),
    c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2) GROUP BY 1),
    q AS (SELECT w.doc_id, CAST(greatest(0, 100 - CASE WHEN coalesce(top, 0) > 50 THEN 20 ELSE 0 END - CASE WHEN len(w) > 0 AND len(list_distinct(w)) / len(w) < 0.3 THEN 15 ELSE 0 END
    - CASE WHEN floor(strlen(text) / len(string_split_regex(text, '[.!?]'))) > 500 THEN 10 WHEN floor(strlen(text) / len(string_split_regex(text, '[.!?]'))) < 10 THEN 5 ELSE 0 END
    - CASE WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g'))) / length(text) < 0.3 THEN 20 ELSE 0 END) AS DOUBLE) AS quality FROM w LEFT JOIN c ON w.doc_id = c.doc_id)"""


@query(_QUALITY + " SELECT doc_id, quality FROM q")
def quality_score(spark, base):
    return _docs(spark, base).select("doc_id", V.quality(F.col("text")).alias("quality"))


@query(
    _QUALITY
    + f""", e AS (SELECT doc_id, text, {_ERRORS} AS e, CASE WHEN len({_HITS}) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: strlen(x) > 10000)) > 0 THEN 1 ELSE 0 END AS w FROM documents)
    SELECT count(*) AS total, count(*) FILTER (len(e) = 0) AS valid, count(*) FILTER (len(e) > 0) AS invalid, CAST(sum(w) AS BIGINT) AS warnings, CAST(sum(len(e)) AS BIGINT) AS errors, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(avg(quality), 6) AS avg_quality
    FROM e JOIN q ON e.doc_id = q.doc_id"""
)
def batch_validation_stats(spark, base):
    return ingest.batch_stats(_docs(spark, base))


@query(f"SELECT doc_id, CAST(len({_W.format('text')}) AS BIGINT) AS words, CAST(greatest(1, floor(len({_W.format('text')}) / 275)) AS BIGINT) AS pages FROM documents")
def word_count(spark, base):
    n = T.word_count(F.col("text"))
    return _docs(spark, base).select("doc_id", n.alias("words"), T.pages_estimate(n).alias("pages"))


def _count(words: list[str]) -> str:
    return " + ".join(f"(length(s) - length(replace(s, '{w}', ''))) // {len(w)}" for w in words)


@query(
    f"""WITH s AS (SELECT doc_id, lower(substring(text, 1, 1000)) AS s FROM documents), n AS (SELECT doc_id, {_count(lexicon.LANGUAGES['en'])} AS en, {_count(lexicon.LANGUAGES['es'])} AS es, {_count(lexicon.LANGUAGES['fr'])} AS fr FROM s)
    SELECT doc_id, CASE WHEN en > es AND en > fr THEN 'en' WHEN es > fr THEN 'es' WHEN fr > 0 THEN 'fr' ELSE 'unknown' END AS language FROM n"""
)
def language_detect(spark, base):
    return _docs(spark, base).select("doc_id", T.language(F.col("text")).alias("language"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g')) AS cleaned, CASE WHEN strlen(trim(string_split(text, chr(10))[1])) BETWEEN 4 AND 99 THEN trim(string_split(text, chr(10))[1]) END AS title,
    trim(substring(text, 1, 200)) || CASE WHEN strlen(text) > 200 THEN '...' ELSE '' END AS excerpt FROM documents"""
)
def clean_title_excerpt(spark, base):
    x = F.col("text")
    return _docs(spark, base).select("doc_id", T.clean(x).alias("cleaned"), T.inferred_title(x).alias("title"), T.excerpt(x).alias("excerpt"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, base):
    return t.read(spark, base, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, base):
    return t.read(spark, base, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT doc_id AS document_id, CAST(i AS INTEGER) AS chunk_index, substring(text, i * 800 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM documents)")
def chunk_fixed(spark, base):
    return chunking.chunks(_docs(spark, base), "fixed")


def _packed_sql(pieces: str, joiner: str, where: str = "true") -> str:
    """Greedy packing as a fold over the pieces, for texts with at least one."""
    j = len(joiner)
    jo = "chr(10) || chr(10)" if joiner == "\n\n" else _lit(joiner)
    return f"""WITH RECURSIVE p AS (SELECT doc_id, {pieces} AS p FROM documents WHERE {where}),
    f AS (SELECT doc_id, p, 1 AS i, 0 AS chunk, p[1] AS held, CAST(NULL AS VARCHAR) AS done FROM p WHERE len(p) > 0
    UNION ALL SELECT doc_id, p, i + 1, CASE WHEN length(held) + {j} + length(p[i + 1]) <= 1000 THEN chunk ELSE chunk + 1 END,
      CASE WHEN length(held) + {j} + length(p[i + 1]) <= 1000 THEN held || {jo} || p[i + 1] ELSE p[i + 1] END,
      CASE WHEN length(held) + {j} + length(p[i + 1]) <= 1000 THEN NULL ELSE held END FROM f WHERE i < len(p))
    SELECT doc_id AS document_id, CAST(chunk - 1 AS INTEGER) AS chunk_index, done AS content FROM f WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, CAST(chunk AS INTEGER), held FROM f WHERE i = len(p)"""


@query(_packed_sql("list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')", "\n\n"))
def chunk_paragraph(spark, base):
    return chunking.chunks(_docs(spark, base), "paragraph", separator="\n")


@query(_packed_sql(r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')", " "))
def chunk_sentence(spark, base):
    return chunking.chunks(_docs(spark, base), "sentence")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_HEADING = r"(?m)^(?:#{1,6} .*|\d+\. .*|[A-Z][A-Z ]+:.*)$"


@query(
    _packed_sql(f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')", "\n\n", f"NOT regexp_matches(text, {_lit(_HEADING)})")
    + rf""" UNION ALL SELECT doc_id, CAST(i - 1 AS INTEGER), p[i] FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, {_lit(_HEADING)}, '\0' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents WHERE regexp_matches(text, {_lit(_HEADING)})))"""
)
def chunk_semantic(spark, base):
    return chunking.chunks(_docs(spark, base), "semantic")


@query(
    f"""WITH d AS (SELECT doc_id, {_sanitise_sql()} AS text FROM documents WHERE len({_ERRORS}) = 0),
    c AS (SELECT doc_id AS document_id, CAST(i AS INTEGER) AS chunk_index, substring(text, i * 800 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM d)),
    s AS (SELECT *, lower(substring(content, 1, 1000)) AS s FROM c), n AS (SELECT *, {_count(lexicon.LANGUAGES['en'])} AS en, {_count(lexicon.LANGUAGES['es'])} AS es, {_count(lexicon.LANGUAGES['fr'])} AS fr FROM s)
    SELECT document_id, chunk_index, CASE WHEN en > es AND en > fr THEN 'en' WHEN es > fr THEN 'es' WHEN fr > 0 THEN 'fr' ELSE 'unknown' END AS language, CAST(len({_W.format('content')}) AS BIGINT) AS word_count, 384 AS dimension FROM n"""
)
def ingest_documents(spark, base):
    return ingest.ingest(_docs(spark, base), size=1000, overlap=200).select("document_id", "chunk_index", "language", "word_count", F.size("embedding").alias("dimension"))


# Query understanding, over the user turns of conversations.
_TURNS = "u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def _turns(spark, base):
    return t.read(spark, base, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def _any(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_lit(p)})" for p in phrases) + ")"


_CLASS = f"""CASE WHEN {_any('lower(text)', lexicon.COMMANDS)} THEN 'Command' WHEN {_any('lower(text)', lexicon.QUESTIONS)} OR suffix(text, '?') THEN 'Question' WHEN {_any('lower(text)', lexicon.TECHNICAL)} THEN 'Technical'
    WHEN {_any('lower(text)', lexicon.CONVERSATIONAL)} THEN 'Conversational' WHEN len({_W.format('text')}) >= 2 THEN 'Search' ELSE 'Unknown' END"""


@query(
    f"""WITH {_TURNS}, k AS (SELECT *, {_CLASS} AS kind FROM u) SELECT conv_id, turn, kind, CAST(round(least(1, 0.5 + CASE WHEN strlen(text) > 20 THEN 0.2 ELSE 0 END
    + CASE WHEN kind = 'Question' AND suffix(text, '?') THEN 0.3 WHEN kind = 'Command' AND prefix(lower(text), 'show') THEN 0.2 WHEN kind = 'Technical' AND contains(lower(text), 'api') THEN 0.2 ELSE 0 END), 6) AS DOUBLE) AS confidence,
    CASE kind WHEN 'Technical' THEN 5 WHEN 'Search' THEN 15 ELSE 10 END AS chunks FROM k"""
)
def query_classify(spark, base):
    k = _turns(spark, base).withColumn("kind", Q.classify(F.col("text")))
    return k.select("conv_id", "turn", "kind", F.round(Q.class_confidence(F.col("text"), F.col("kind")), 6).alias("confidence"), Q.search_options(F.col("kind"))["chunks"].alias("chunks"))


@query(
    f"""WITH {_TURNS}, v AS (SELECT conv_id, turn, trim(text) AS s FROM u) SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN s = '' THEN 'EmptyQuery' END, CASE WHEN s <> '' AND strlen(s) < 3 THEN 'TooShort' END, CASE WHEN strlen(s) > 2000 THEN 'TooLong' END,
    CASE WHEN len({_W.format('s')}) > 50 THEN 'TooManyTerms' END, CASE WHEN {" OR ".join(f"regexp_matches(s, {_lit(p)})" for p in lexicon.MALICIOUS)} THEN 'MaliciousContent' END, CASE WHEN contains(s, '  ') THEN 'ExcessiveWhitespace' END], lambda x: x IS NOT NULL), ',') AS issues FROM v"""
)
def query_issues(spark, base):
    return _turns(spark, base).select("conv_id", "turn", F.array_join(Q.issues(F.col("text")), ",").alias("issues"))


_PSTOP = "[" + ", ".join(_lit(w) for w in lexicon.PROCESSOR_STOP_WORDS) + "]"


@query(
    rf"""WITH {_TURNS} SELECT conv_id, turn, array_to_string(list_filter(list_transform({_W.format('lower(text)')}, lambda w: regexp_replace(w, '[^a-z0-9''-]', '', 'g')), lambda w: w <> '' AND NOT list_contains({_PSTOP}, w)), ' ') AS tokens,
    trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9\s.,!?-]', '', 'g'), '\s+', ' ', 'g')) AS preprocessed FROM u"""
)
def query_tokens(spark, base):
    return _turns(spark, base).select("conv_id", "turn", F.array_join(Q.tokens(F.col("text")), " ").alias("tokens"), T.preprocess(F.col("text")).alias("preprocessed"))


def _map(*tables: dict[str, list[str]]) -> str:
    return "(VALUES " + ", ".join(f"({_lit(k)}, {i}, {j}, {_lit(v)})" for i, table in enumerate(tables) for k, vs in table.items() for j, v in enumerate(vs)) + ") AS m(k, i, j, v)"


@query(
    f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, x, p FROM (SELECT conv_id, turn, unnest({_W.format('lower(text)')}) AS x, unnest(range(1, 1 + len({_W.format('lower(text)')}))) AS p FROM u)),
    e AS (SELECT conv_id, turn, v, min(p * 100 + i * 10 + j) AS o FROM w JOIN {_map(lexicon.GENERAL_SYNONYMS, lexicon.TECHNICAL_SYNONYMS)} ON k = x GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS n FROM e)
    SELECT u.conv_id, u.turn, coalesce(string_agg(v, ',' ORDER BY o), '') AS synonyms FROM u LEFT JOIN r ON u.conv_id = r.conv_id AND u.turn = r.turn AND n <= 10 GROUP BY 1, 2"""
)
def expand_synonyms(spark, base):
    return _turns(spark, base).select("conv_id", "turn", F.array_join(Q.synonyms(F.col("text")), ",").alias("synonyms"))


def _looked(x: str, *tables: dict[str, list[str]]) -> str:
    """All expansions of a word, table after table."""
    each = ["CASE " + x + " " + " ".join(f"WHEN {_lit(k)} THEN [{', '.join(map(_lit, v))}]" for k, v in table.items()) + " ELSE []::VARCHAR[] END" for table in tables]
    return f"list_concat({each[0]}, {each[1]})"


def _expanded(*tables: dict[str, list[str]]) -> str:
    return f"flatten(list_transform(w, lambda x: {_looked('x', *tables)}))"


def _first(x: str) -> str:
    return f"list_slice(list_filter({x}, lambda v, i: list_position({x}, v) = i), 1, 10)"


def _negations(x: str) -> str:
    """(term, place, handling) of each negation, as the operator finds them."""
    found = []
    for n in lexicon.NEGATIONS:
        at = f"instr(lower({x}), {_lit(n)})"
        rest = f"substring(lower({x}), {at} + {len(n)})"
        term = f"split_part({rest}, ' ', 1)"
        handling = f"CASE WHEN strlen({term}) < 3 THEN 'keep' WHEN {term} = 'error' THEN 'success' WHEN {term} = 'problem' THEN 'solution' ELSE 'exclude' END"
        found.append(f"CASE WHEN {at} > 0 AND contains({rest}, ' ') AND {term} <> '' THEN {term} || ':' || ({at} - 1) || ':' || {handling} END")
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def _replaced(x: str, table: dict[str, str], to: str) -> str:
    for k, v in table.items():
        x = f"regexp_replace({x}, '{chr(92)}b{k}{chr(92)}b', {_lit(to.format(k=k, v=v))}, 'g')"
    return x


_ENHANCED = """CASE WHEN kind = 'Technical' AND contains(low, 'function') THEN text || ' method procedure routine' WHEN kind = 'Technical' AND contains(low, 'error') THEN text || ' exception bug issue problem'
    WHEN kind = 'Question' AND contains(low, 'how to') THEN text || ' tutorial guide instructions steps' ELSE text END"""
_EXPANSION = rf"""{_TURNS},
    e0 AS (SELECT conv_id, turn, text, lower(text) AS low, {_W.format('lower(text)')} AS w, {_W.format('text')} AS wt, {_CLASS} AS kind, {_replaced(_replaced('text', lexicon.SPELLINGS, '{v}'), lexicon.ACRONYMS, '{k} {v}')} AS y,
      list_filter(list_transform({_W.format('lower(text)')}, lambda w: regexp_replace(w, '[^a-z0-9''-]', '', 'g')), lambda w: w <> '' AND NOT list_contains({_PSTOP}, w)) AS tk FROM u),
    e1 AS (SELECT *, {_expanded(lexicon.GENERAL_SYNONYMS, lexicon.TECHNICAL_SYNONYMS)} AS s0, {_expanded(lexicon.HYPERNYMS, lexicon.RELATED)} AS m0, {_expanded(lexicon.DOMAIN, lexicon.HIERARCHIES)} AS d0, {_negations('text')} AS neg, {_negations('y')} AS yneg,
      list_filter([CASE WHEN contains(text, '?') AND trim(replace(text, '?', '')) <> '' THEN trim(replace(text, '?', '')) END, CASE WHEN {_any('low', ['implement', 'create', 'build', 'make'])} AND NOT prefix(low, 'how to') THEN 'how to ' || text END, CASE WHEN NOT prefix(low, 'what is') AND NOT contains(text, '?') THEN 'what is ' || text END], lambda x: x IS NOT NULL) AS alt FROM e0),
    e2 AS (SELECT *, {_first('s0')} AS syn, {_first('m0')} AS sem, {_first('d0')} AS dom,
      trim(regexp_replace(replace(replace(y, 'error', CASE WHEN len(list_filter(yneg, lambda x: suffix(x, ':success'))) > 0 THEN 'success' ELSE 'error' END), 'problem', CASE WHEN len(list_filter(yneg, lambda x: suffix(x, ':solution'))) > 0 THEN 'solution' ELSE 'problem' END), '\s+', ' ', 'g')) AS refined FROM e1),
    e3 AS (SELECT *, least(1, 0.5 + 0.2 * (len(syn) + len(sem)) / 10 + CASE WHEN len(neg) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(alt) > 0 THEN 0.1 ELSE 0 END) AS expansion,
      least(1, 0.5 + CASE WHEN strlen(text) > 20 THEN 0.2 ELSE 0 END + CASE WHEN kind = 'Question' AND suffix(text, '?') THEN 0.3 WHEN kind = 'Command' AND prefix(low, 'show') THEN 0.2 WHEN kind = 'Technical' AND contains(low, 'api') THEN 0.2 ELSE 0 END) AS cc FROM e2)"""


@query(
    f"""WITH {_EXPANSION}, t AS (SELECT conv_id, turn, list_distinct(w) AS w, list_filter(syn, lambda x: NOT list_contains(sem, x)) AS s, sem FROM e3)
    SELECT conv_id, turn, unnest(list_filter(w, lambda x: NOT list_contains(s, x) AND NOT list_contains(sem, x))) AS term, CAST(1.0 AS DOUBLE) AS weight FROM t
    UNION ALL SELECT conv_id, turn, unnest(s), 0.6 FROM t UNION ALL SELECT conv_id, turn, unnest(sem), 0.48 FROM t"""
)
def term_weights(spark, base):
    w = _turns(spark, base).select("conv_id", "turn", F.explode(Q.term_weights(F.col("text"))).alias("term", "weight"))
    return w


@query(
    f"""WITH {_TURNS} SELECT conv_id, turn, trim(regexp_replace({"".join("regexp_replace(" for _ in lexicon.SPELLINGS)}text{"".join(f", '{chr(92)}b{k}{chr(92)}b', '{v}', 'g')" for k, v in lexicon.SPELLINGS.items())}, '\\s+', ' ', 'g')) AS spelled,
    CAST(contains(text, '?') AND trim(replace(text, '?', '')) <> '' AS INTEGER) + CAST({_any('lower(text)', ['implement', 'create', 'build', 'make'])} AND NOT prefix(lower(text), 'how to') AS INTEGER) + CAST(NOT prefix(lower(text), 'what is') AND NOT contains(text, '?') AS INTEGER) AS alternatives FROM u"""
)
def query_refinement(spark, base):
    x = F.col("text")
    return _turns(spark, base).select("conv_id", "turn", F.trim(F.regexp_replace(Q.spelled(x), r"\s+", " ")).alias("spelled"), F.size(Q.alternatives(x)).alias("alternatives"))


@query(
    f"""WITH {_EXPANSION} SELECT conv_id, turn, refined, array_to_string(neg, ',') AS negations, array_to_string(syn, ',') AS synonyms, array_to_string(sem, ',') AS semantic, array_to_string(dom, ',') AS domain, array_to_string(alt, '|') AS alternatives,
    CAST(round(expansion, 6) AS DOUBLE) AS confidence, CAST(round(least(1, 0.1 * len(tk) + CASE WHEN kind = 'Technical' THEN 0.3 ELSE 0 END + 0.2 * len(neg) + 0.1 * len(alt)), 6) AS DOUBLE) AS complexity, {_ENHANCED} AS enhanced,
    array_to_string(list_filter(list_transform(range(1, len(wt)), lambda i: wt[i] || ' ' || wt[i + 1]), lambda x: regexp_matches(x, '^\\p{{Lu}}\\S* \\p{{Lu}}')), ',') AS entities FROM e3"""
)
def query_expansion(spark, base):
    """All stages of expansion side by side."""
    x = F.col("text")
    negations = F.transform(Q.negations(x), lambda n: F.concat_ws(":", n["term"], n["place"], n["handling"]))
    return _turns(spark, base).select(
        "conv_id",
        "turn",
        Q.refined(x).alias("refined"),
        F.array_join(negations, ",").alias("negations"),
        F.array_join(Q.synonyms(x), ",").alias("synonyms"),
        F.array_join(Q.semantic_terms(x), ",").alias("semantic"),
        F.array_join(Q.domain_terms(x), ",").alias("domain"),
        F.array_join(Q.alternatives(x), "|").alias("alternatives"),
        F.round(Q.expansion_confidence(x), 6).alias("confidence"),
        F.round(Q.complexity_score(x), 6).alias("complexity"),
        Q.enhanced(x, Q.classify(x)).alias("enhanced"),
        F.array_join(Q.entities(x), ",").alias("entities"),
    )


_KEYS = {1: b"0123456789abcdef", 2: b"fedcba9876543210"}


@query("SELECT doc_id, sha256(text) AS hash, 1 + doc_id % 2 AS key_version, true AS same FROM documents")
def field_encryption(spark, base):
    """Texts encrypted under one of two keys and read back."""
    d = _docs(spark, base).withColumn("e", F.when(F.col("doc_id") % 2 == 0, crypto.encrypt(F.col("text"), _KEYS, 1)).otherwise(crypto.encrypt(F.col("text"), _KEYS, 2)))
    back = crypto.decrypt(F.col("e"), _KEYS)
    return d.select("doc_id", crypto.content_hash(back).alias("hash"), F.col("e.key_version").cast("long").alias("key_version"), (back == F.col("text")).alias("same"))


@query(
    f"""WITH {_EXPANSION}, g AS (SELECT *, 0.6 * cc + 0.4 * expansion AS whole, least(0.3, 0.1 * len(syn)) + least(0.2, 0.05 * len(sem)) AS grow FROM e3),
    c AS (SELECT *, CASE WHEN grow > 0 THEN least(20, CAST(floor(CASE WHEN kind = 'Technical' THEN 5 ELSE 10 END * (1 + grow)) AS INTEGER)) WHEN kind = 'Technical' THEN 5 ELSE 10 END AS c1, CASE WHEN kind = 'Technical' THEN 0.8 ELSE 0.7 END AS t1 FROM g),
    h AS (SELECT *, CASE WHEN len(neg) > 0 THEN least(0.9, t1 + 0.1) ELSE t1 END AS t2 FROM c), i AS (SELECT *, CASE WHEN expansion < 0.5 THEN least(0.85, t2 + 0.05) ELSE t2 END AS t3 FROM h),
    r AS (SELECT *, list_filter([CASE WHEN whole < 0.5 THEN 'rephrase' END, CASE WHEN len(tk) < 3 THEN 'add terms' END, CASE WHEN len(syn) + len(sem) = 0 THEN 'expand with synonyms' END, CASE WHEN len(neg) > 0 THEN 'check negations' END, CASE WHEN kind = 'Unknown' THEN 'state the intent' END], lambda x: x IS NOT NULL) AS rec FROM i)
    SELECT conv_id, turn, CASE WHEN expansion > 0.6 THEN trim(refined || ' ' || array_to_string(list_concat(syn, sem), ' ')) WHEN expansion > 0.4 THEN refined ELSE {_ENHANCED} END AS final_query,
    CAST(round(CASE WHEN whole < 0.5 THEN greatest(0.5, t3 - 0.1) WHEN whole > 0.8 THEN least(0.9, t3 + 0.05) ELSE t3 END, 6) AS DOUBLE) AS threshold, CASE WHEN whole < 0.5 THEN least(20, c1 + 3) ELSE c1 END AS chunks, kind = 'Question' AS citations,
    CAST(round(whole, 6) AS DOUBLE) AS confidence, CASE WHEN len(rec) = 0 THEN 'good' ELSE array_to_string(rec, ',') END AS recommendations FROM r"""
)
def query_tuning(spark, base):
    """Final query, options, confidence and recommendations of each user turn."""
    r = _turns(spark, base).withColumn("f", Q.facts(F.col("text"))).withColumn("c", Q.confidences(F.col("f")))
    f, c = F.col("f"), F.col("c")
    r = r.withColumn("o", Q.tuned_options(f, c))
    return r.select("conv_id", "turn", Q.final_query(f, c).alias("final_query"), "o.threshold", "o.chunks", "o.citations", F.round("c.overall", 6).alias("confidence"), F.array_join(Q.recommendations(f, c), ",").alias("recommendations"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'unset') AS language, source, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS n FROM documents")
def metadata_merge(spark, base):
    """The primary's values where it has them, the secondary's otherwise."""
    primary = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("language"), F.col("lang"), F.lit("kind"), F.lit("text")))
    secondary = F.create_map(F.lit("language"), F.lit("unset"), F.lit("source"), F.col("source"))
    m = crypto.merged(primary, secondary)
    return _docs(spark, base).select("doc_id", F.element_at(m, "language").alias("language"), F.element_at(m, "source").alias("source"), F.size(m).alias("n"))
