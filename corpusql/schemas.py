"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField
METADATA = T.StructType(
    [
        _f("author", T.StringType()),
        _f("created_date", T.TimestampType()),
        _f("modified_date", T.TimestampType()),
        _f("language", T.StringType()),
        _f("tags", T.ArrayType(T.StringType())),
        _f("category", T.StringType()),
        _f("word_count", T.IntegerType()),
        _f("page_count", T.IntegerType()),
        _f("file_type", T.StringType()),
        _f("file_size", T.LongType()),
        _f("custom_fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
DOCUMENT = T.StructType(
    [
        _f("id", T.StringType(), False),
        _f("title", T.StringType()),
        _f("content", T.StringType()),
        _f("file_path", T.StringType()),
        _f("file_type", T.StringType()),
        _f("file_size", T.LongType()),
        _f("metadata", METADATA),
        _f("created_at", T.TimestampType()),
        _f("updated_at", T.TimestampType()),
    ]
)
CHUNK = T.StructType(
    [
        _f("id", T.StringType(), False),
        _f("document_id", T.StringType()),
        _f("chunk_index", T.IntegerType()),
        _f("content", T.StringType()),
        _f("embedding", T.ArrayType(T.FloatType())),
        _f("metadata", T.StringType()),
        _f("created_at", T.TimestampType()),
    ]
)
AUDIT_EVENT = T.StructType(
    [
        _f("id", T.StringType(), False),
        _f("ts", T.TimestampType()),
        _f("event_type", T.StringType()),
        _f("user_id", T.StringType()),
        _f("resource_id", T.StringType()),
        _f("action", T.StringType()),
        _f("severity", T.StringType()),
        _f("success", T.BooleanType()),
        _f("duration_ms", T.DoubleType()),
        _f("data_size", T.LongType()),
        _f("details", T.MapType(T.StringType(), T.StringType())),
    ]
)
HOLD = T.StructType([_f("active", T.BooleanType()), _f("expires_at", T.TimestampType())])
RETENTION_RECORD = T.StructType(
    [
        _f("data_id", T.StringType(), False),
        _f("data_type", T.StringType()),
        _f("created_at", T.TimestampType()),
        _f("expires_at", T.TimestampType()),
        _f("status", T.StringType()),
        _f("data_size", T.LongType()),
        _f("holds", T.ArrayType(HOLD)),
    ]
)
CONSENT = T.StructType(
    [
        _f("user_id", T.StringType(), False),
        _f("purpose", T.StringType()),
        _f("consent_given", T.BooleanType()),
        _f("ts", T.TimestampType()),
        _f("expires_at", T.TimestampType()),
        _f("withdrawn", T.BooleanType()),
    ]
)
CACHE_ENTRY = T.StructType(
    [
        _f("key", T.StringType(), False),
        _f("model", T.StringType()),
        _f("version", T.StringType()),
        _f("size_bytes", T.LongType()),
        _f("created_at", T.TimestampType()),
        _f("last_accessed", T.TimestampType()),
        _f("access_count", T.LongType()),
        _f("expires_at", T.TimestampType()),
    ]
)
