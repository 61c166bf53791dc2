"""The catalogue of this subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusql.llm.decontaminate import SQL as DECONTAMINATE_SQL
from corpusql.llm.line_dedup import SQL as LINE_DEDUP_SQL
from corpusql.llm.near_dedup import SQL as NEAR_SQL
from corpusql.llm.warc import SQL as WARC_SQL

#: The vocabulary of the token operators; another file can be named without a code change.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1


def vocabulary() -> str:
    """Path of the vocabulary file: ``CORPUSQL_VOCABULARY``, else the one of the public set."""
    if at := os.environ.get("CORPUSQL_VOCABULARY"):
        return at
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.secrets import base_of, joined, links, scan

    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base_of(F.col("found"))), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), links(F.col("found")).alias("links"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.html import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.token_files import token_table

    return token_table(_table(spark, sf_dir, "documents"), vocabulary(), end=END_ID)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.lm_score import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary(), end=END_ID)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.decontaminate import decontaminate

    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.warc import archive_table

    out = archive_table(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.line_dedup import line_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.whitening import whiten

    out = whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusql.llm.simhash import simhash_duplicates

    return simhash_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_files": op3_token_files,
    "op4_lm_score": op4_lm_score,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
}

ORACLES: dict[str, str] = {"op7_decontamination": DECONTAMINATE_SQL, "op8_near_duplicates": NEAR_SQL, "op9_warc": WARC_SQL, "op10_line_dedup": LINE_DEDUP_SQL}
