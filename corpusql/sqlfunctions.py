"""The engine's functions under names that SQL can use.

Scalar and table functions are SQL functions, so Catalyst sees through them: nothing leaves
the JVM.  Spark joins what a table function of SQL makes back by its arguments, that is by the
texts: over large tables unfold the arrays of ``cq_chunk_places`` and ``cq_front_entries``
with ``LATERAL VIEW inline``, which moves nothing.  ``cq_contexts`` reads an ordered partition of a table with a state of one context;
it is a Python table function.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

_SUM = "aggregate({0}, 0D, (a, x) -> a + x)"
_DOT = _SUM.format("zip_with(CAST(a AS ARRAY<DOUBLE>), CAST(b AS ARRAY<DOUBLE>), (x, y) -> x * y)")
FUNCTIONS = {
    "cq_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": _DOT,
    "cq_norm(v ARRAY<FLOAT>) RETURNS DOUBLE": f"sqrt({_SUM.format('transform(CAST(v AS ARRAY<DOUBLE>), x -> x * x)')})",
    "cq_cosine_score(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "CASE WHEN size(a) <> size(b) OR cq_norm(a) * cq_norm(b) = 0 THEN 0.5D ELSE 1 - greatest(0D, least(2D, 1 - cq_dot(a, b) / (cq_norm(a) * cq_norm(b)))) / 2 END",
    "cq_words(t STRING) RETURNS ARRAY<STRING>": r"filter(split(t, '\\s+'), w -> w <> '')",
    "cq_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
    "cq_chunks(t STRING, n INT, overlap INT) RETURNS ARRAY<STRING>": "CASE WHEN length(t) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(0, CAST(ceil(length(t) / (n - overlap)) AS INT) - 1), i -> substring(t, i * (n - overlap) + 1, n)) END",
    # The rows of the table functions below as arrays, for `LATERAL VIEW inline`.
    "cq_chunk_places(t STRING, n INT, overlap INT) RETURNS ARRAY<STRUCT<chunk_index: INT, start: INT, content: STRING>>": "transform(cq_chunks(coalesce(t, ''), n, overlap), (c, i) -> named_struct('chunk_index', i, 'start', i * (n - overlap), 'content', c))",
    "cq_front_entries(t STRING) RETURNS ARRAY<STRUCT<place: INT, name: STRING, value: STRING>>": r"transform(filter(transform(split(regexp_extract(coalesce(t, ''), '(?s)\\A---\\n(.*?)\\n---\\n', 1), '\n'), (line, i) -> named_struct('i', i, 'line', line)), x -> instr(x.line, ':') > 0), x -> named_struct('place', x.i, 'name', trim(substring_index(x.line, ':', 1)), 'value', regexp_replace(trim(substring(x.line, instr(x.line, ':') + 1)), '^\"(.*)\"$', '$1')))",
}
TABLE_FUNCTIONS = {
    # Chunks of a text with the place of their first character, from 0.
    "cq_chunk_rows(t STRING, n INT, overlap INT) RETURNS TABLE(chunk_index INT, start INT, content STRING)": "SELECT i, i * (n - overlap), c FROM (SELECT posexplode(cs) AS (i, c) FROM (SELECT cq_chunks(coalesce(t, ''), n, overlap) AS cs))",
    # The lines `name: value` between two lines `---` that a text begins with, quotes around values dropped.
    "cq_front_matter(t STRING) RETURNS TABLE(place INT, name STRING, value STRING)": r"SELECT i, trim(substring_index(line, ':', 1)), regexp_replace(trim(substring(line, instr(line, ':') + 1)), '^\"(.*)\"$', '$1') FROM (SELECT posexplode(split(regexp_extract(coalesce(t, ''), '(?s)\\A---\\n(.*?)\\n---\\n', 1), '\n')) AS (i, line)) WHERE instr(line, ':') > 0",
}


@udtf(returnType="document_id long, context int, first int, last int, content string")
class Contexts:
    """Successive chunks of a document joined by empty lines while they fit in ``most`` characters.

    Called with a table of ``document_id, chunk_index, content`` partitioned by document and
    ordered by chunk; a chunk that alone is longer is a context of its own.
    """

    def __init__(self) -> None:
        self.number, self.held = 0, None

    def eval(self, row: Row, most: int) -> Iterator[tuple]:
        key, place, text = row["document_id"], row["chunk_index"], row["content"] or ""
        if self.held and len(self.held[3]) + 2 + len(text) <= most:
            self.held = (*self.held[:2], place, f"{self.held[3]}\n\n{text}")
            return
        yield from self.terminate()
        self.held = (key, place, place, text)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            key, first, last, text = self.held
            yield key, self.number, first, last, text
            self.number, self.held = self.number + 1, None


def register(spark: SparkSession) -> None:
    """Make them known to the session, in place of earlier ones of these names."""
    spark.udtf.register("cq_contexts", Contexts)
    for head, body in (FUNCTIONS | TABLE_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
