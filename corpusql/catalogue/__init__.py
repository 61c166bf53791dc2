"""Queries over the test tables, each with the SQL that must give the same rows.

``QUERIES[name](spark, base)`` is a DataFrame; ``SQL[name]`` is for DuckDB over views of the
same tables.  A name without SQL has semantics that SQL can't express.
"""

from corpusql.catalogue import formats, governance, search, service, text

QUERIES = {**search.QUERIES, **text.QUERIES, **governance.QUERIES, **service.QUERIES, **formats.QUERIES}
SQL = {**search.SQL, **text.SQL, **governance.SQL, **service.SQL, **formats.SQL}
