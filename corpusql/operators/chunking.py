"""Cutting documents into chunks: one row a chunk with ``chunk_index`` from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fixed(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Pieces of ``size`` characters that start every ``size - overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap from 0, less than size")
    step = size - overlap
    n = F.ceil(F.length(text) / step).cast("int")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def packed(pieces: Column, size: int, joiner: str) -> Column:
    """Successive pieces joined while they fit in ``size`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["held"] == "") | (F.length(a["held"]) + len(joiner) + F.length(x) <= size)
        return F.struct(
            F.when(fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))).alias("out"),
            F.when(a["held"] == "", x).when(fits, F.concat(a["held"], F.lit(joiner), x)).otherwise(x).alias("held"),
        )

    return F.aggregate(pieces, start, step, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))


def paragraphs(text: Column, size: int = 1000, separator: str = "\n\n") -> Column:
    """Paragraphs packed up to ``size``, blank lines between them."""
    pieces = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    out = packed(pieces, size, "\n\n")
    return F.when(F.size(out) > 0, out).otherwise(fixed(text, size, size // 5))


def sentences(text: Column, size: int = 1000) -> Column:
    """Sentences (up to ``. ! ?`` and white space) packed up to ``size``."""
    pieces = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda p: p != "")
    out = packed(pieces, size, " ")
    return F.when(F.size(out) > 0, out).otherwise(fixed(text, size, size // 5))


def semantic(text: Column, size: int = 1000, keep_tail: bool = True) -> Column:
    """Parts that end with a heading (``#``, ``1.`` or ``CAPITALS:``); paragraphs without headings.

    ``keep_tail=False`` drops what stands after the last heading.
    """
    heading = r"(?m)^(?:#{1,6} .*|\d+\. .*|[A-Z][A-Z ]+:.*)$"
    marked = F.split(F.regexp_replace(text, heading, "$0\u0000"), "\u0000")
    kept = marked if keep_tail else F.slice(marked, 1, F.size(marked) - 1)
    parts = F.filter(F.transform(kept, strip), lambda p: p != "")
    return F.when(text.rlike(heading), parts).otherwise(paragraphs(text, size))


STRATEGIES = {"fixed": fixed, "paragraph": paragraphs, "sentence": sentences, "semantic": semantic}


def chunks(df: DataFrame, strategy: str = "fixed", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``document_id, chunk_index, content`` (null text: no chunk)."""
    pieces = STRATEGIES[strategy](F.coalesce(F.col(text_col), F.lit("")), **options)
    return df.select(F.col(id_col).alias("document_id"), F.posexplode(pieces).alias("chunk_index", "content"))
