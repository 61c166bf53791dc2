"""WARC archives of records compressed one by one with a shared Zstandard dictionary.

The dictionary is built from a bounded sample of the records and stands in a skippable frame
(magic 0x184D2A5D) at the head of every file, so each file can be read by itself; each
record is a frame of its own.  Of records with equal payloads of at least ``least_bytes``
the one with the largest page id is a ``response`` and the others are ``revisit`` records
that name it by record id, target URI and date.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from corpusql.llm.common import fits, materialise, new_path
from corpusql.llm.token_files import filesystem, put

# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def build_dictionary(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A trained dictionary; of samples too few to train on, their content; of none, nothing."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def response_id(page_id: int | None, digest: str) -> str:
    """The record id of the response that revisits of a payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def record(kind: str, record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: tuple[int, str | None, bool] | None, date: str) -> bytes:
    """One WARC record; a revisit carries the HTTP head and no payload.

    ``refers_to``: page id and url of a revisit's response, and whether it is the only row
    with this id and payload, so that it has the id of ``response_id``.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = lambda u: quote(u, safe="".join(map(chr, range(33, 127))))
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target(url)}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        page, uri, single = refers_to
        lines.append(f"WARC-Profile: {PROFILE}")
        if single:
            lines.append(f"WARC-Refers-To: {response_id(page, digest)}")
        if uri is not None:
            lines += [f"WARC-Refers-To-Target-URI: {target(uri)}", f"WARC-Refers-To-Date: {date}"]
        lines.append(f"X-Refers-To-Page-ID: {page}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Collects records of one file."""

    def __init__(self, dictionary: bytes, level: int = 6):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
        self.parts = [struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary]
        self.size = len(self.parts[0])
        self.n = 0

    def add(self, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.parts.append(frame)
        self.size += len(frame)
        self.n += 1

    def close(self) -> bytes:
        return b"".join(self.parts)


def parse(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an open archive."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE_DICTIONARY:
        raise ValueError("no dictionary frame")
    dictionary = f.read(n)
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    with zstandard.ZstdDecompressor(dict_data=shared).stream_reader(f, read_across_frames=True, closefd=False) as stream:
        held = b""
        while True:
            while (cut := held.find(b"\r\n\r\n")) < 0:
                more = stream.read(1 << 16)
                if not more:
                    if held:
                        raise ValueError("archive ends inside a record")
                    return
                held += more
            lines = held[:cut].decode().split("\r\n")
            if lines[0] != VERSION:
                raise ValueError("not a WARC record")
            head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
            need = cut + 4 + int(head["content-length"]) + 4
            if len(held) < need:
                parts, have = [held], len(held)
                while have < need:
                    more = stream.read(max(1 << 16, need - have))
                    if not more:
                        raise ValueError("archive ends inside a record")
                    parts.append(more)
                    have += len(more)
                held = b"".join(parts)
            yield head, held[cut + 4 : need - 4]
            held = held[need:]


def write_archives(df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, file_bytes: int = 64 << 20, sample_records: int = 400, sample_bytes: int = 1 << 16, broadcast_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record below ``path``; one row a file: ``file``, ``n_records``.

    Payloads are compared by SHA-1 and length over all rows.  Null payload counts as empty,
    null url leaves its header out.  A null page id is less than any; rows that share the
    largest id of their payload are all responses.  The table of repeated payloads is sent
    to all executors if it is within ``broadcast_bytes`` and joined by digest otherwise.
    The dictionary is built from about ``sample_records`` distinct payloads, ``sample_bytes``
    of each at most: those whose digest hashes below a limit that is set from the number of
    distinct payloads, so what reaches the driver doesn't depend on the input or its
    partitions.
    """
    spark = df.sparkSession
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    big = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size", "id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    shared = big.groupBy("digest", "size").agg(F.sum("n").alias("n"), F.max(F.struct("id", (F.col("n") == 1).alias("single"), "url")).alias("last"))
    shared = materialise(shared.where("n > 1").select("digest", "size", "last"), "warc-repeats")
    small = fits(shared, F.octet_length(F.coalesce("last.url", F.lit(""))) + 80, broadcast_bytes)
    dictionary = spark.sparkContext.broadcast(build_dictionary(_samples(rows, sample_records, sample_bytes, date)))
    rows = rows.join(F.broadcast(shared) if small else shared, ["digest", "size"], "left").select("id", "url", "html", "digest", "size", "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, archive = TaskContext.get().partitionId(), 0, Archive(dictionary.value)

        def name() -> str:
            return f"archive-{part:06d}-{done:06d}.warc.zst"

        def close() -> pa.RecordBatch:
            put(f"{path}/{name()}", archive.close())
            return pa.RecordBatch.from_pydict({"file": [name()], "n_records": [archive.n]})

        for b in batches:
            for page, url, text, digest, size, last in zip(*(c.to_pylist() for c in b.columns)):
                refers = None if last is None or page == last["id"] else (last["id"], last["url"], last["single"])
                if last is not None and refers is None and last["single"]:
                    record_id = response_id(page, digest)
                else:
                    record_id = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{path}/{name()} {archive.n}')}>"
                archive.add(record("revisit" if refers else "response", record_id, page, url, text.encode(), digest, size, refers, date))
                if archive.size >= file_bytes:
                    yield close()
                    archive, done = Archive(dictionary.value), done + 1
        if archive.n:
            yield close()

    return materialise(rows.mapInArrow(write, "file string, n_records long"), "warc-files")


def _samples(rows: DataFrame, records: int, size: int, date: str) -> list[bytes]:
    """Records of about ``records`` distinct payloads (fewer if there are fewer), chosen by their digest."""
    distinct = rows.agg(F.approx_count_distinct("digest").alias("n")).first()["n"] or 1
    limit = min(1 << 32, (records << 32) // distinct + 1)
    chosen = rows.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 32)) < limit).groupBy("digest").agg(F.min(F.substring("html", 1, size)).alias("html"))
    return [record("response", response_id(0, "0"), 0, None, r["html"].encode(), "00" * 20, len(r["html"]), None, date) for r in chosen.collect()]


def read_archives(files: DataFrame, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row a record of the files that ``write_archives`` listed.

    ``page_id, url, payload_bytes, payload_digest`` (lower-case hexadecimal SHA-1),
    ``record_type, refers_to`` (the response's page id, for revisits), with
    ``with_payload`` also ``payload`` (null for revisits).  A payload that doesn't agree
    with its digest is an error.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_payload
    number = lambda x: None if x is None else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = filesystem(f"{path}/{name}")
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(at, compression=None) as f:
                    for head, block in parse(f):
                        cut = block.index(b"\r\n\r\n") + 4
                        n = int(re.search(rb"(?i)content-length: (\d+)", block[:cut])[1])
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        payload = block[cut:]
                        kind = head["warc-type"]
                        if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {head.get('x-page-id')} is damaged")
                        rows.append((number(head.get("x-page-id")), head.get("warc-target-uri"), n, digest, kind, number(head.get("x-refers-to-page-id")), *[payload.decode() if kind == "response" else None] * with_payload))
                        size += len(payload) * with_payload
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(n, "file").mapInArrow(read, schema)


def archive_table(df: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Write archives below ``path`` (a new folder in the shared one by default) and read them back."""
    path = path or new_path(df.sparkSession, "warc")
    return read_archives(write_archives(df, path, **options), path)


#: The rows that reading back must give, in DuckDB's SQL, for unique page ids.
SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.last IS NOT NULL AND m.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last IS NOT NULL AND m.last <> p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000
"""
