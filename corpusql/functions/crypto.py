"""Hashes and encrypted fields.

Keys are named by version: new values use the current key, old ones stay readable.  The keys
are literals of the plan, so keep such plans out of logs (``spark.sql.redaction``) or pass
the keys as columns of a protected table.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(text: Column, model: str, version: str) -> Column:
    """The same text under another model or version is another key."""
    return F.sha2(F.concat_ws("\u0001", F.lit(model), F.lit(version), text), 256)


def key_hash(api_key: Column) -> Column:
    return F.sha2(api_key, 256)


def encrypt(text: Column, keys: dict[int, bytes], version: int) -> Column:
    """Struct of base64 ``data`` (AES-GCM with a nonce of its own for each value) and ``key_version``; null stays null."""
    data = F.base64(F.aes_encrypt(text, F.lit(keys[version]), F.lit("GCM")))
    return F.when(text.isNotNull(), F.struct(data.alias("data"), F.lit(version).alias("key_version")))


def decrypt(value: Column, keys: dict[int, bytes]) -> Column:
    """The text of an encrypted struct; null for a version without a key, or data that was changed."""
    out = F.lit(None).cast("string")
    for v, k in keys.items():
        out = F.when(value["key_version"] == v, F.try_aes_decrypt(F.unbase64(value["data"]), F.lit(k), F.lit("GCM")).cast("string")).otherwise(out)
    return out


def merged(primary: Column, secondary: Column) -> Column:
    """Map of both, where the primary's values count."""
    none = F.create_map().cast("map<string,string>")
    p, s = F.coalesce(primary, none), F.coalesce(secondary, none)
    return F.map_concat(F.map_filter(s, lambda k, v: ~F.map_contains_key(p, k)), p)
