"""Packing documents into sequences: first-fit decreasing over a tournament tree of bins.

Documents are dealt into randomised groups (by a seeded hash of id and text); each group is
packed by itself, so groups are the unit of work and of memory.  In a group a document is
cut into full sequences and a remainder; the remainders, longest first, each go into the
first bin with room for them, found in a tournament tree of the bins' capacities.  As an
option the emptiest bins are then taken apart to fill the gaps of the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusql.llm.encoder import encoder


class Tournament:
    """Free room of bins; ``first(x)`` is the leftmost bin with room for ``x``."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [0] * (2 * self.leaves)
        for i in range(bins):
            self.room[self.leaves + i] = capacity
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def first(self, x: int) -> int:
        if self.room[1] < x:
            return -1
        i = 1
        while i < self.leaves:
            i = 2 * i if self.room[2 * i] >= x else 2 * i + 1
        return i - self.leaves

    def take(self, b: int, x: int) -> None:
        i = self.leaves + b
        self.room[i] -= x
        i //= 2
        while i:
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
            i //= 2


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``; equal lengths keep their order."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree = Tournament(len(lengths), capacity)
    bins: list[list[int]] = []
    for i in order:
        b = tree.first(lengths[i])
        tree.take(b, lengths[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_group(lengths: list[int], capacity: int, refill: bool = False) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` for documents of these lengths.

    Every id of every document is in exactly one piece and no sequence exceeds ``capacity``.
    With ``refill`` gaps are filled from the emptiest sequences, which cuts more documents;
    sequences that are full, or whose length is a power of two and so need no padding, are
    left alone.
    """
    full, rest = [], []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            full.append([(d, at, capacity)])
            at += capacity
        if n > at:
            rest.append((d, at, n - at))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([n for _, _, n in rest], capacity)]
    if not refill:
        return full + bins
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if used[b] & (used[b] - 1)), key=lambda b: (-used[b], b))
    taker, giver = 0, len(order) - 1
    while taker < giver:
        t, g = order[taker], order[giver]
        gap = capacity - used[t]
        if not gap:
            taker += 1
            continue
        d, at, n = bins[g].pop()
        m = min(n, gap)
        bins[t].append((d, at, m))
        if n > m:
            bins[g].append((d, at + m, n - m))
        used[t] += m
        used[g] -= m
        giver -= not bins[g]
    return full + [b for b in bins if b]


def pack_documents(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int | None = None, group_docs: int = 2048, group_bytes: int = 8 << 20, refill: bool = False, seed: int = 17, with_tokens: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``start``: the document's ids before the piece; ``offset``: its place in its sequence,
    gapless from 0; ``ids_crc32``: of the piece's ids as little-endian 32-bit integers;
    ``doc_tokens``: ids of the document with the end id; ``with_tokens`` adds ``tokens``.
    Groups have about ``group_docs`` documents and ``group_bytes`` of text at most, whatever
    their number; only a single longer text exceeds that.  Null text counts as empty (only
    the end id; nothing at all without one), null ids and equal rows are packed like others
    (rows without an id are dealt by their place, so equal ones don't meet in one group),
    and other columns are not read.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    n = max(1, -(-total["n"] // group_docs), -(-(total["b"] or 0) // group_bytes))
    place = F.coalesce("k", F.monotonically_increasing_id())
    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), place, F.col("k").isNull(), "t"), F.lit(n)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", tokens array<int>" * with_tokens

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("t", "ascending")])
        group = table.column("g")[0].as_py()
        ids = table.column("k").to_pylist()
        tokens = encoder(vocabulary, end).encode(table.column("t"))
        out: list[tuple] = []
        for s, pieces in enumerate(pack_group([len(t) for t in tokens], capacity, refill)):
            at = 0
            for d, start, length in pieces:
                piece = tokens[d][start : start + length]
                out.append((ids[d], start, length, zlib.crc32(piece.astype("<u4").tobytes()), len(tokens[d]), (group << 32) + s, at, *[piece.astype(np.int32)] * with_tokens))
                at += length
        columns = list(zip(*out)) or [[] for _ in schema.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_tokens
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.groupBy("g").applyInArrow(pack, schema)


def padding(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences, ids and padding ids in all; a sequence as long as a power of two has none."""
    s = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return s.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padding"))
