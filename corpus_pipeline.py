"""Cleaning documents in five stages; each works on all that the stage before it kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusql.llm.common import materialise
from corpusql.llm.decontaminate import decontaminate
from corpusql.llm.line_dedup import line_dedup
from corpusql.llm.near_dedup import near_duplicates
from corpusql.llm.packing import pack_documents
from corpusql.llm.quality import quality_rules
from corpusql.llm.queries import END_ID, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs, keep=list(COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of three lines go; a document left without text goes too."""
    out = line_dedup(docs.select(*COLUMNS)).where("n_removed = 0 or length(trim(text)) > 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; so do rows without an id."""
    verdict = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(verdict, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a run of words with the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, keep=list(COLUMNS)).where("not contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences into which the documents are packed."""
    return pack_documents(docs, vocabulary(), end=END_ID)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near), ("decontamination", decontaminated), ("packing", packed)]

#: Hashed shingles, first-fit packing and the vocabulary have no SQL form; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
