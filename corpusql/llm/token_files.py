"""Token files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a row of parts that any zstandard reader accepts:

1. data frames, each the ids of some whole documents (little-endian, 2 or 4 bytes an id),
   about ``frame_bytes`` before compression; a longer document has a frame of its own;
2. a skippable frame (magic 0x184D2A50) with the directory, itself one zstandard frame:
   ``TOKENDIR``, the bytes of an id, the number of documents, then their document ids
   (64 bits), flags (1: the document id is null) and token counts (64 bits);
3. a skippable frame (magic 0x184D2A5E) with the seek table of the seekable format: for each
   data frame the compressed size, the size, and the low 32 bits of XXH64 of its content,
   then the number of frames, the descriptor byte 0x80 and the magic 0x8F92EAB1.

A reader takes the tail, then the directory, then only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from corpusql.llm.common import materialise, new_path, shared_dir
from corpusql.llm.encoder import encoder

# Fixed values of the formats.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80


def pack(doc_ids: list[int | None], tokens: list[np.ndarray], *, id_bytes: int = 4, frame_bytes: int = 1 << 18, level: int = 3) -> bytes:
    """The bytes of one file with these documents in this order."""
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    if id_bytes == 2 and any(len(t) and int(t.max()) > 0xFFFF for t in tokens):
        raise ValueError("an id does not fit in 2 bytes")
    out, entries = [], []
    writer = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def close(parts: list[bytes]) -> None:
        raw = b"".join(parts)
        frame = writer.compress(raw)
        out.append(frame)
        entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    held, size = [], 0
    for t in tokens:
        raw = t.astype(kind).tobytes()
        if size and size + len(raw) > frame_bytes:
            close(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        close(held)
    n = len(doc_ids)
    directory = b"TOKENDIR" + struct.pack("<BQ", id_bytes, n) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array([len(t) for t in tokens], "<i8").tobytes()
    directory = writer.compress(directory)
    out.append(struct.pack("<II", SKIPPABLE_DIRECTORY, len(directory)) + directory)
    table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUMS, SEEK_MAGIC)
    out.append(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
    return b"".join(out)


class Reader:
    """Random access to one file (an object with ``seek`` and ``read``, of ``size`` bytes)."""

    def __init__(self, f, size: int):
        self.f = f
        n, descriptor, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or not descriptor & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = 12 * n + 9
        head = struct.unpack("<II", self._read(size - table - 8, 8))
        if head != (SKIPPABLE_SEEK, table):
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(self._read(size - table, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])]).astype(np.int64)
        magic, length = struct.unpack("<II", self._read(int(self.at[-1]), 8))
        if magic != SKIPPABLE_DIRECTORY:
            raise ValueError("no directory")
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[-1]) + 8, length))
        self.id_bytes, m = struct.unpack("<BQ", raw[8:17])
        self.doc_ids = np.frombuffer(raw, "<i8", m, 17)
        self.nulls = np.frombuffer(raw, np.uint8, m, 17 + 8 * m).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", m, 17 + 9 * m)
        self.byte_at = np.concatenate([[0], np.cumsum(self.counts) * self.id_bytes]).astype(np.int64)
        self.frame_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])]).astype(np.int64)
        self._open = (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def frame(self, k: int) -> bytes:
        """The content of data frame ``k``, checked."""
        if self._open[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._open = k, raw
        return self._open[1]

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document; only its frame is read."""
        if not self.counts[i]:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.frame_at, self.byte_at[i], "right")) - 1
        start = int(self.byte_at[i] - self.frame_at[k])
        raw = self.frame(k)[start : start + int(self.counts[i]) * self.id_bytes]
        return np.frombuffer(raw, "<u2" if self.id_bytes == 2 else "<u4").astype(np.uint32)


def filesystem(path: str):
    """The file system of a URI or path and the path in it (local, HDFS and object stores)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(path: str, content: bytes) -> None:
    """Write a file so that it is there whole or not at all; a repeated task writes the same again."""
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(content)
    fs.move(part, at)


def write_token_files(df: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end: int | None = None, file_tokens_bytes: int = 32 << 20, id_bytes: int = 4, partitions: int | None = None) -> DataFrame:
    """Encode ``text_col`` and write token files in ascending order of ``id_col``.

    The rows are dealt by ranges of the id, so file names and the documents in them ascend
    together; a task writes a new file whenever ``file_tokens_bytes`` are full.  Null ids
    come first; rows with one id are ordered by their text, equal rows are all kept; null
    text counts as empty; other columns are not read.  Returns one row a file:
    ``file`` (its name below ``path``), ``n_docs``, ``n_tokens``, in a table of its own.
    """
    rows = df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, done = encoder(vocabulary, end), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{done:06d}.zst"
            put(f"{path}/{name}", pack(ids, tokens, id_bytes=id_bytes))
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(ids)], "n_tokens": [sum(map(len, tokens))]}, pa.schema({"file": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64()}))

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                ids.append(k)
                tokens.append(t)
                size += id_bytes * len(t)
                if size >= file_tokens_bytes:
                    yield close()
                    ids, tokens, size, done = [], [], 0, done + 1
        if ids:
            yield close()

    return materialise(rows.mapInArrow(write, "file string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, path: str, *, wanted: set[int] | None = None, with_tokens: bool = False) -> DataFrame:
    """One row a document from the files that ``write_token_files`` listed.

    Returns ``doc_id``, ``start`` (ids of all documents before it in file order),
    ``n_tokens``, ``ids_crc32`` (unsigned, of the ids as little-endian 32-bit integers) and
    with ``with_tokens`` also ``tokens`` (array of int).  ``wanted``: only these documents
    are decompressed and returned.
    """
    # One row a file: the running sum is over the list of files, not over documents.
    from pyspark.sql import Window

    files = files.withColumn("before", F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<int>" * with_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = filesystem(f"{path}/{name}")
                with fs.open_input_file(at) as f:
                    r = Reader(f, f.size())
                    starts = before + np.cumsum(r.counts) - r.counts
                    keep = [i for i in range(len(r.counts)) if wanted is None or not r.nulls[i] and int(r.doc_ids[i]) in wanted]
                    for lo in range(0, len(keep), 2000):
                        some = keep[lo : lo + 2000]
                        toks = [r.tokens(i) for i in some]
                        cols = [
                            pa.array([None if r.nulls[i] else int(r.doc_ids[i]) for i in some], pa.int64()),
                            pa.array(starts[some], pa.int64()),
                            pa.array(r.counts[some], pa.int64()),
                            pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in toks], pa.int64()),
                        ]
                        if with_tokens:
                            cols.append(pa.array([t.astype(np.int32) for t in toks], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return files.select("file", "before").repartition(n, "file").mapInArrow(read, schema)


def token_table(df: DataFrame, vocabulary: str, *, path: str | None = None, **options) -> DataFrame:
    """Write token files below ``path`` (a new folder in the shared one by default) and read them back."""
    spark = df.sparkSession
    shared_dir(spark)
    path = path or new_path(spark, "tokens")
    return read_token_files(write_token_files(df, path, vocabulary, **options), path)
