"""Documents from files, by extension, and simple sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from corpusql.functions import text as T

TEXTS = ("txt", "text")
SUPPORTED = TEXTS + ("md", "markdown", "html", "htm", "rtf", "docx", "pdf")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word file, one a line; empty if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


def _docx(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda b: None if b is None else docx_text(bytes(b)))


def read_files(spark: SparkSession, path: str, most_bytes: int = 50 << 20, pdf: Column | None = None, recursive: bool = True) -> DataFrame:
    """One row a file: ``path, file_type, file_size, title, text, status``.

    ``status`` is ok, or why there is no text (type, empty, size, unreadable); a bad file
    never stops the others.  ``pdf``: a column expression over ``content`` for PDF files,
    which are unreadable without one.  Contents over ``most_bytes`` are not loaded; files
    of no bytes at all are left out by the reader.
    """
    return documents_of(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path), most_bytes, pdf)


def documents_of(files: DataFrame, most_bytes: int = 50 << 20, pdf: Column | None = None, hash_as: str | None = None) -> DataFrame:
    """The same of rows as the reader of binary files gives them; ``hash_as``: a column for the hash of the content (of larger files null)."""
    own = [F.sha2("content", 256).alias(hash_as)] if hash_as else []
    own += [F.col("path"), T.extension(F.col("path")).alias("file_type"), F.col("length").alias("file_size")]
    ext, plain, text = F.col("file_type"), F.col("plain"), F.col("text")
    # A column each, so that a content is decoded once and plans stay small.
    read = files.where(F.col("length") <= most_bytes).select(*own, "content").withColumn("plain", F.when(~ext.isin("docx", "pdf"), T.decode(F.col("content"))))
    texts = (
        F.when(ext.isin("txt", "text"), plain)
        .when(ext.isin("md", "markdown"), T.markdown_text(plain))
        .when(ext.isin("html", "htm"), T.html_text(plain))
        .when(ext == "rtf", T.rtf_text(plain))
        .when(ext == "docx", F.pandas_udf(_docx, StringType())(F.when(ext == "docx", F.col("content"))))
        .when(ext == "pdf", pdf if pdf is not None else F.lit(None).cast("string"))
        .when(T.likely_text(plain), plain)
    )
    title = F.coalesce(
        F.when(ext.isin("md", "markdown"), T.markdown_title(plain)),
        F.when(ext.isin("html", "htm"), F.nullif(T.html_title(plain), F.lit(""))),
        T.inferred_title(text),
        F.nullif(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("")),
        F.lit("Untitled Document"),
    )
    rows = read.withColumn("text", texts).select(*([hash_as] if hash_as else []), "path", "file_type", "file_size", title.alias("title"), "text")
    status = F.when(F.col("text").isNull(), F.when(F.col("file_type").isin(*SUPPORTED), "unreadable").otherwise("type")).when(~F.col("text").rlike(r"\S"), "empty").otherwise("ok")
    large = files.where(F.col("length") > most_bytes).select(*own[-3:])
    return rows.withColumn("status", status).unionByName(large.withColumn("status", F.lit("size")), allowMissingColumns=True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _store(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def save(folder: str, name: str, content: bytes) -> str:
    """Keep one file (an upload, from the driver) in the store ``folder``; its path."""
    fs, at = _store(folder.rstrip("/"))
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
        f.write(content)
    return f"{folder.rstrip('/')}/{name}"


def remove(path: str) -> bool:
    """Delete one file; whether it was there."""
    fs, at = _store(path)
    there = fs.get_file_info(at).is_file
    if there:
        fs.delete_file(at)
    return there
