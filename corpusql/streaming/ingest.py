"""A stream of files: each new one becomes a document in a table, or a row that tells why not.

Files of any supported type that appear in a folder are taken once, ``files_a_batch`` at a
time.  A document's key is the hash of its content, so a file that comes again under another
name makes no document but a row among the copies, and a batch that is run again after a
failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusql.functions import validation as V
from corpusql.sources import files

DOCUMENTS = "hash string, path string, file_type string, file_size long, title string, text string, language string"
COPIES = "hash string, path string, file_type string, file_size long"
REJECTED = f"{COPIES}, status string"
BINARY = "path string, modificationTime timestamp, length long, content binary"


#: The hashes of so many batches are written together.
SPAN = 8


def documents(spark: SparkSession, out: str) -> DataFrame:
    """The documents so far, as ``DOCUMENTS`` names their columns, with ``batch``."""
    return spark.read.schema(f"{DOCUMENTS}, batch long").parquet(f"{out}/documents")


def _if_there(read: Callable[[], DataFrame], otherwise: Callable[[], DataFrame | None]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return otherwise()


def _spans(m: int, after: int = 0) -> list[int]:
    """The folders of hashes that together hold the spans from ``after`` to ``m``.

    Folder i holds as many spans up to the i-th as the lowest bit of i says: there are as many
    folders to read as i has bits, and a hash is written that often at most.
    """
    found = []
    while m > after:
        found.append(m)
        m &= m - 1
    return found


def _hashes(spark: SparkSession, out: str, batches: range, spans: list[int]) -> DataFrame:
    return spark.read.schema("hash string").parquet(*[f"{out}/documents/batch={n}" for n in batches], *[f"{out}/hashes/{i}" for i in spans])


def known(spark: SparkSession, out: str, number: int) -> DataFrame:
    """The hashes of the documents that other batches than ``number`` have.

    They are read from the batches since the last span and the spans before; where one of those
    is not there (a table from before there were spans, a batch out of turn), from the table.
    """
    table = lambda: documents(spark, out).where(F.col("batch") != number).select("hash")
    whole = lambda: _if_there(table, lambda: spark.createDataFrame([], "hash string"))
    m = number // SPAN
    return _if_there(lambda: _hashes(spark, out, range(m * SPAN, number), _spans(m)), whole) if number else whole()


def _end_span(spark: SparkSession, out: str, m: int) -> None:
    """Write folder ``m`` of the hashes, after the last batch of its span."""
    after = m & (m - 1)
    table = lambda: documents(spark, out).where(F.col("batch").between(after * SPAN, m * SPAN - 1)).select("hash")
    held = _if_there(lambda: _hashes(spark, out, range((m - 1) * SPAN, m * SPAN), _spans(m - 1, after)), table)
    held.hint("rebalance").write.mode("overwrite").parquet(f"{out}/hashes/{m}")


def judged(batch: DataFrame, most_bytes: int, pdf: Column | None) -> DataFrame:
    """What the files hold, why not where they don't, and in what language."""
    from corpusql.functions import text as T

    rows = files.documents_of(batch, most_bytes, pdf, "hash")
    rows = rows.withColumns({"errors": F.array_join(V.errors(F.coalesce("text", F.lit(""))), ","), "sample": T.language_sample(F.col("text"))})
    counts = T.counts_by_language(F.col("sample"))
    rows = rows.withColumns({f"n_{k}": n for k, n in counts.items()})
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("errors") != "", F.col("errors")).otherwise("ok")
    language = T.language_of({k: F.col(f"n_{k}") for k in counts})
    return rows.select("hash", "path", "file_type", "file_size", "title", "text", language.alias("language"), status.alias("status"))


def store(rows: DataFrame, number: int, out: str, most_files: int) -> None:
    """One batch of what files hold, as ``judged`` has it.

    A batch owns a folder of each table: what it writes and reads grows with the batch, and
    with the table only as the spans of hashes do.
    """
    spark = rows.sparkSession
    # Read again below; files are read once.  The next batch takes its place.
    at = f"{out}/staged"
    rows.write.mode("overwrite").option("compression", "none").parquet(at)
    rows = spark.read.schema(f"{DOCUMENTS}, status string").parquet(at)
    # A row a file of this batch, whose paths the stream's source has on the driver as well.
    found = rows.select("hash", "path", "status").collect()
    new: dict[str, str] = {}
    for r in found:
        if r.status == "ok":
            # The file with the smallest path stands for all of its content.
            new[r.hash] = min(r.path, new.get(r.hash, r.path))
    if new:
        for r in known(spark, out, number).where(F.col("hash").isin(list(new))).collect():
            new.pop(r.hash, None)
    ok, path = F.col("status") == "ok", F.col("path")
    kept = list(new.values())
    rows.where(ok & path.isin(kept)).drop("status").coalesce(most_files).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")

    def aside(table: str, part: DataFrame, any_: bool) -> None:
        # Most batches have none; one that is taken again by other limits may have had some.
        to = f"{out}/{table}/batch={number}"
        if any_ or _if_there(lambda: spark.read.schema(COPIES).parquet(to), lambda: None) is not None:
            part.coalesce(1).write.mode("overwrite").parquet(to)

    copy = ["hash", "path", "file_type", "file_size"]
    aside("copies", rows.where(ok & ~path.isin(kept)).select(copy), sum(r.status == "ok" for r in found) > len(kept))
    aside("rejected", rows.where(~ok).select(*copy, "status"), any(r.status != "ok" for r in found))
    if (number + 1) % SPAN == 0:
        _end_span(spark, out, (number + 1) // SPAN)


def take(batch: DataFrame, number: int, out: str, most_bytes: int, pdf: Column | None, most_files: int) -> None:
    """One batch of files; taking it again leaves the same tables."""
    store(judged(batch, most_bytes, pdf), number, out, most_files)


def ingest_files(spark: SparkSession, folder: str, out: str, files_a_batch: int = 10, most_bytes: int = 50 << 20, pdf: Column | None = None, most_files: int = 2) -> int:
    """Take what is new in ``folder``; the number of batches that this took.

    ``most_files``: into how many files a batch's documents go at most.
    """
    done = []

    def each(rows: DataFrame, number: int) -> None:
        store(rows, number, out, most_files)
        done.append(number)

    stream = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(folder)
    # Part of the stream, so that the expressions are made once and not for every batch.
    judged(stream, most_bytes, pdf).writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return len(done)


def copies(spark: SparkSession, out: str) -> DataFrame:
    """The files whose content another file had before, or by a smaller path in the same batch."""
    return _if_there(lambda: spark.read.schema(COPIES).parquet(f"{out}/copies"), lambda: spark.createDataFrame([], COPIES))


def rejected(spark: SparkSession, out: str) -> DataFrame:
    return _if_there(lambda: spark.read.schema(REJECTED).parquet(f"{out}/rejected"), lambda: spark.createDataFrame([], REJECTED))
