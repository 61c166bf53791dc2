"""Rows of documents, chunks and logs: reading, listing, checking, changing, counting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusql.errors import ValidationError
from corpusql.functions import lexicon
from corpusql.functions.text import extension
from corpusql.functions.validation import some

MAX_UPLOAD = 50 * 1024 * 1024
STRATEGIES = ("fixed_size", "fixed", "semantic", "sentence", "paragraph")


def by_id(table: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows with these few ids; the condition reaches the scan."""
    return table.where(F.col(key).isin(list(ids)))


def listed(table: DataFrame, order: Column, text: str | None = None, equal: dict[str, object] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows whose ``content`` has ``text`` (in either case) and whose columns equal the values given, in order, from ``offset``."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValidationError("limit", "from 1 to 100, offset from 0")
    if text:
        table = table.where(F.lower("content").contains(text.lower()))
    for c, v in (equal or {}).items():
        table = table.where(F.col(c) == v)
    return table.orderBy(order).offset(offset).limit(limit)


def history(log: DataFrame, user: object | None = None, model: str | None = None, time: tuple[float | None, float | None] = (None, None), limit: int = 100, offset: int = 0) -> DataFrame:
    """The latest entries by user, model and processing time (from, to)."""
    for c, v in (("user_id", user), ("model", model)):
        if v is not None:
            log = log.where(F.col(c) == v)
    if time[0] is not None:
        log = log.where(F.col("processing_time") >= time[0])
    if time[1] is not None:
        log = log.where(F.col("processing_time") <= time[1])
    return log.orderBy(F.desc("ts"), "event_id").offset(offset).limit(limit)


def batch_delete(table: DataFrame, key: str, ids: list, most: int = 100) -> DataFrame:
    """What stays when at most ``most`` ids go."""
    if not ids or len(ids) > most:
        raise ValidationError("ids", f"from 1 to {most}")
    return table.where(~F.coalesce(F.col(key).isin(list(ids)), F.lit(False)))


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """Rows to be written, with the time of the change."""
    return rows.withColumn("updated_at", now)


def request_issues(text: Column, threshold: Column, max_chunks: Column, most: int = 10_000) -> Column:
    """What is wrong with a request."""
    return some(
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "text: empty"),
        F.when(F.octet_length(text) > most, "text: too long"),
        F.when(~threshold.between(0, 1), "threshold: from 0 to 1"),
        F.when(~max_chunks.between(1, 50), "max_chunks: from 1 to 50"),
    )


def upload_issues(path: Column, length: Column, metadata: Column | None = None, strategy: Column | None = None, most: int = MAX_UPLOAD) -> Column:
    """What keeps a file out: extension, size, metadata that is no JSON object, an unknown way of chunking."""
    ext = extension(path)
    found = [
        F.when(ext == "", "no extension").when(~ext.isin(list(lexicon.FILE_TYPES)), F.concat(F.lit("extension "), ext)),
        F.when(length == 0, "empty"),
        F.when(length > most, "too large"),
    ]
    if metadata is not None:
        found.append(F.when(metadata.isNotNull() & F.json_object_keys(metadata).isNull(), "metadata: not JSON"))
    if strategy is not None:
        found.append(F.when(~F.lower(strategy).isin(list(STRATEGIES)), "strategy"))
    return some(*found)


def batch_lines(rows: DataFrame, batch: str, order: str, text: str, upper: Callable[[Column], Column] = F.upper) -> DataFrame:
    """``rows`` with ``line``: the place in the batch and the text in capitals."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(order)) - 1
    return rows.withColumn("line", F.format_string("BATCH[%d]: %s", place, upper(F.col(text))))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def batch_summary(rows: DataFrame, kind: str, confidence: str) -> DataFrame:
    """Rows and mean confidence, in all (``kind`` null) and by kind, in one pass."""
    return rows.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias(confidence))


def compared(rows: DataFrame, name: str, score: str) -> DataFrame:
    """Rows, mean and best score, by ``name``."""
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.max(score), 6).alias("best"))
