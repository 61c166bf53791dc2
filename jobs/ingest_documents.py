"""Incremental ingest: new document files become validated, sanitised, chunked rows for retrieval.

    python jobs/ingest_documents.py --config jobs/ingest_documents.toml --source DIR --target DIR

Files that appear in ``source`` (a folder of Parquet files, or a glob) are taken once, by a
file stream whose checkpoint knows them; a run ends when nothing new is left.  Each batch of
files is one narrow pass without a shuffle, written as

    target/documents/batch=<n>/status=<accepted|rejected>/language=<..>/*.parquet
    target/runs/batch=<n>/*.json

A batch has a folder of its own that is replaced as a whole, so a batch that is run again
after a failure leaves the same rows, and nothing written before it is ever touched.  A
document that comes again in a later file has a newer version; ``current`` reads the newest.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import tomllib

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from corpusql.functions import text as T
from corpusql.functions import validation as V
from corpusql.operators import chunking

log = logging.getLogger("ingest_documents")

SOURCE = "doc_id long, text string"
ROWS = "document_id long, version long, chunk_index int, content string, words long, reasons string, batch int, status string, language string"
DEFAULTS = {"strategy": "fixed", "size": 1000, "overlap": 200, "files_per_batch": 64}


def prepared(docs: DataFrame, strategy: str, **options) -> DataFrame:
    """One row a chunk of an accepted document, one row a rejected document with its reasons."""
    text = F.coalesce("text", F.lit(""))
    clean = docs.select("doc_id", F.xxhash64("text").alias("version"), V.errors(text).alias("found"), V.sanitise(text).alias("clean"))
    reasons = F.concat("found", V.some(F.when(F.col("doc_id").isNull(), "no id"), F.when((F.size("found") == 0) & (F.col("clean") == ""), "no text")))
    judged = clean.select("doc_id", "version", "clean", reasons.alias("found"))
    good = F.size("found") == 0
    pieces = F.when(good, chunking.STRATEGIES[strategy](F.col("clean"), **options)).otherwise(F.array().cast("array<string>"))
    # What a document has is made before its chunks are, and its text goes no further.
    told = judged.select(
        F.col("doc_id").alias("document_id"),
        "version",
        F.when(good, "accepted").otherwise("rejected").alias("status"),
        F.when(good, T.language(F.col("clean"))).otherwise("unknown").alias("language"),
        F.when(~good, F.array_join("found", ",")).alias("reasons"),
        pieces.alias("pieces"),
    )
    rows = told.select("document_id", "version", "status", "language", "reasons", F.posexplode_outer("pieces").alias("chunk_index", "content"))
    return rows.select("document_id", "version", "chunk_index", "content", T.word_count(F.col("content")).alias("words"), "reasons", "status", "language")


def write_batch(docs: DataFrame, batch: int, target: str, options: dict) -> None:
    """Write one batch and what it did; doing so again gives the same files' rows."""
    seen = Observation(f"batch-{batch}")
    first = F.coalesce("chunk_index", F.lit(0)) == 0
    rows = prepared(docs, **options).observe(
        seen,
        F.count_if(first & (F.col("status") == "accepted")).alias("accepted"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("chunk_index").isNotNull()).alias("chunks"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
    )
    rows.write.mode("overwrite").partitionBy("status", "language").parquet(f"{target}/documents/batch={batch}")
    counts = {k: int(seen.get[k]) for k in ("accepted", "rejected", "chunks", "bytes")}
    docs.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)).coalesce(1).write.mode("overwrite").json(f"{target}/runs/batch={batch}")
    log.info("batch %d: %s to %s/documents", batch, ", ".join(f"{v} {k}" for k, v in counts.items()), target)


def run(spark: SparkSession, source: str, target: str, checkpoint: str | None = None, **settings) -> int:
    """Take what is new in ``source``; the number of batches that this took.

    ``checkpoint`` (default: a folder of ``target``) and ``target`` belong together.
    Settings: ``strategy``, ``files_per_batch`` and the options of the chunking strategy.
    """
    options = DEFAULTS | settings
    if options["strategy"] != "fixed":  # the others' chunks don't overlap
        options.pop("overlap")
    files = options.pop("files_per_batch")
    done = []

    def each(docs: DataFrame, batch: int) -> None:
        write_batch(docs, batch, target, options)
        done.append(batch)

    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %d new batches", source, len(done))
    return len(done)


def stored(spark: SparkSession, target: str) -> DataFrame:
    """All versions, as written; an empty table before the first batch."""
    try:
        return spark.read.schema(ROWS).parquet(f"{target}/documents")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROWS)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's newest accepted version: ``document_id, chunk_index, language, words, content``.

    A rejected version leaves the one before it in place.  Of several versions in one batch
    the one with the largest hash counts, so that any order of files gives the same; equal
    rows of a batch count once.
    """
    rows = stored(spark, target).where("status = 'accepted'")
    newest = rows.groupBy("document_id").agg(F.max(F.struct("batch", "version")).alias("n")).select("document_id", "n.batch", "n.version")
    kept = rows.join(newest, ["document_id", "batch", "version"]).dropDuplicates(["document_id", "chunk_index"])
    return kept.select("document_id", "chunk_index", "language", "words", "content")


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """``document_id, reasons`` of the versions that were turned away, equal ones once."""
    return stored(spark, target).where("status = 'rejected'").select("document_id", "version", "reasons").distinct().select("document_id", "reasons")


def main(args: list[str] | None = None) -> None:
    from corpusql.session import session

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", help="a TOML file; what the command line names comes before it")
    for name in ("source", "target", "checkpoint", "master"):
        p.add_argument(f"--{name}")
    given = p.parse_args(args)
    config = {}
    if given.config:
        with open(given.config, "rb") as f:
            config = tomllib.load(f)
    config |= {k: v for k, v in vars(given).items() if v is not None and k != "config"}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("ingest_documents", config.pop("master", None))
    try:
        run(spark, config.pop("source"), config.pop("target"), config.pop("checkpoint", None), **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
