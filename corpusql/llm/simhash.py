"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits; two link if they differ in at most ``radius`` (3) of them.
To find all such pairs, each bit position gets a nonzero vector of ``radius + 1`` binary
coordinates, and each nonzero ``v`` gives a mask: the positions whose vector has an odd
product with ``v``.  The vectors of at most ``radius`` differing positions lie in a proper
subspace, so some ``v`` is orthogonal to all of them, and under its mask the two fingerprints
agree.  So with ``2 ** (radius + 1) - 1`` (15) tables *every* pair within the radius meets in
some table; nothing depends on chance.  A mask covers 32 to 36 positions, and two unlike
fingerprints meet in a table with a probability of about 2 ** -34.

Equal fingerprints are one class.  In a bucket of up to ``bucket`` classes each class is
compared with what is not reached yet, and the links of a spanning forest leave the task:
fewer than the classes, however many pairs are alike.  A larger bucket is never held in one
task: its classes agree on the mask, so the same construction is applied to the positions
left (28 to 32), and then again; after three rounds all but at most 8 positions are fixed and
a bucket holds 256 classes at most.  Links are exact at every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusql.llm.common import fits, materialise
from corpusql.llm.near_dedup import components
from corpusql.llm.vectext import SPACED_LOWER, Block, blocks

BITS = 64
ROUNDS = 3
CHUNK = 1 << 16  # shingles whose hashes are held at once


def _normal(block: Block) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words lower-cased and joined by one space, their starts and ends there, and each text's first word (one more at the end)."""
    inside = SPACED_LOWER[block.data] != 0
    start, end = block.spans_of(inside)
    upper = (block.data >= 65) & (block.data <= 90)
    low = np.where(upper, block.data + 32, block.data).astype(np.uint8)
    size = end - start
    to = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    place = np.repeat(to - start, size) + np.flatnonzero(inside)
    out[place] = low[inside]
    return out.tobytes(), to, to + size, np.searchsorted(start, block.offsets)


def fingerprints(block: Block, k: int = 3) -> np.ndarray:
    """The fingerprint of each text of the block: shingles with repeats, XXH64 with seed 42, a bit where over half have it."""
    raw, start, end, first = _normal(block)
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
    doc = np.repeat(np.arange(block.n), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    a, b = start[at], end[np.minimum(at + k, first[doc + 1]) - 1]
    hash_ = partial(xxhash.xxh64_intdigest, seed=42)
    ones = np.zeros((block.n, BITS), np.int64)
    for i in range(0, len(doc), CHUNK):
        d = doc[i : i + CHUNK]
        h = np.fromiter((hash_(raw[x:y]) for x, y in zip(a[i : i + CHUNK].tolist(), b[i : i + CHUNK].tolist())), "<u8", len(d))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    set_ = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def fingerprinted(rows: DataFrame, k: int = 3) -> DataFrame:
    """``rows`` (id, t) to (id, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(block.first, block.n), pa.array(fingerprints(block, k))], names=["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def covering(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``: any ``radius`` of them lie outside some mask.  Vectors are given to positions in turn, so masks are of nearly equal size."""
    n = 2 ** (radius + 1) - 1
    of = {p: 1 + i % n for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (of[p] & v).bit_count() % 2) for v in range(1, n + 1)]


def masks(radius: int, rounds: int = ROUNDS) -> list[list[tuple[int, int, int]]]:
    """For each round (parent, table, mask): ``mask`` fixes the parent's positions and its own."""
    out, known = [], {0: 0}
    for _ in range(rounds):
        level, now = [], {}
        for parent, fixed in known.items():
            for own in covering([p for p in range(BITS) if not fixed >> p & 1], radius):
                table = len(level) + 1
                now[table] = fixed | own
                level.append((parent, table, fixed | own))
        out.append(level)
        known = now
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table(spark: SparkSession, level: list[tuple[int, int, int]]) -> DataFrame:
    """A later round's masks, by parent: of fixed size (3,375 in the last of three rounds)."""
    return spark.createDataFrame([(p, t, _signed(m)) for p, t, m in level], "parent int, table int, mask long").groupBy("parent").agg(F.collect_list(F.struct("table", "mask")).alias("masks"))


def forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Indices of the links of a spanning forest of the ``fp`` (distinct) that differ in at most ``radius`` bits."""
    a, b = [], []
    left = np.arange(len(fp))
    ahead: list[int] = []
    while len(left):
        if ahead:
            i = ahead.pop()
        else:
            i, left = int(left[0]), left[1:]
        near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
        found = left[near].tolist()
        a += [i] * len(found)
        b += found
        ahead += found
        left = left[~near]
    return a, b


def links(spark: SparkSession, classes: DataFrame, radius: int, bucket: int, broadcast_bytes: int) -> DataFrame:
    """``a, b``: links that connect whatever the pairs of ``classes`` (fp, id) within the radius connect."""

    def join_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch is carried on, as more of it may come."""
        held = [np.zeros(0, np.int64)] * 3

        def ends(key: np.ndarray, fp: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
            fp = fp.view(np.uint64)
            cut = np.flatnonzero(np.diff(key)) + 1
            first, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(key)]]))
            two = first[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = [id_[two]], [id_[two + 1]]
            for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                x, y = forest(fp[i : i + n], radius)
                a.append(id_[i : i + n][x])
                b.append(id_[i : i + n][y])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([x, np.asarray(c)]) for x, c in zip(held, batch.columns)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                at = len(held[0]) - int(np.argmax(held[0][::-1] != held[0][-1]))
                yield ends(*[x[:at] for x in held])
                held = [x[at:] for x in held]
        if len(held[0]):
            yield ends(*held)

    found = None
    level = classes.select("fp", "id", F.lit(0).alias("table"))
    levels = masks(radius)
    for i, own in enumerate(levels):
        last = i == len(levels) - 1
        if i == 0:
            masked = level.withColumn("masks", F.array(*[F.struct(F.lit(t).alias("table"), F.lit(_signed(m)).alias("mask")) for _, t, m in own]))
        else:
            masked = level.withColumnRenamed("table", "parent").join(F.broadcast(_table(spark, own)), "parent")
        each = masked.select("fp", "id", F.explode("masks").alias("m"))
        keyed = each.select("fp", "id", F.col("m.table").alias("table"), F.xxhash64("m.table", F.col("fp").bitwiseAND(F.col("m.mask"))).alias("key"))
        # Counts are combined before they are dealt; of most buckets, of one class, nothing more moves.
        shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("z")).where("z > 1"), "simhash-buckets")
        met = keyed.join(F.broadcast(shared) if fits(shared, F.lit(16), broadcast_bytes) else shared, "key")
        small = met if last else met.where(F.col("z") <= bucket)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = small.select("key", "fp", "id").repartition(n, "key").sortWithinPartitions("key").mapInArrow(join_buckets, "a long, b long").distinct()
        pairs = materialise(pairs, "simhash-links")
        found = pairs if found is None else found.unionByName(pairs)
        if last or shared.where(F.col("z") > bucket).isEmpty():
            return found
        level = materialise(met.where(F.col("z") > bucket).select("fp", "id", "table"), "simhash-crowds")
    return found


def simhash_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3, bucket: int = 4096, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id``.

    Words are split at white space after lower-casing A-Z; shingles are runs of ``k`` words
    with repeats (a shorter text is one), joined by a space.  A text without words, empty or
    null, has the fingerprint zero and is linked like any other.  ``component_id`` is the
    smallest id that links lead to, the document's own included.  Rows with a null id get a
    fingerprint and a null component and link nothing.  Equal rows give equal results; rows
    with one id and different texts count as one document with several texts.  Other columns
    are not read.  ``radius`` may be 1 to 3; ``bucket`` changes the cost and not the result.
    """
    if not 1 <= radius <= 3:
        raise ValueError("a radius of 1 to 3 bits")
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    made = materialise(fingerprinted(rows, k), "simhash")
    some = made.where("id is not null")
    classes = materialise(some.groupBy("fp").agg(F.min("id").alias("id")), "simhash-classes")
    pairs = links(spark, classes, radius, bucket, broadcast_bytes)
    # An id with several fingerprints connects them.
    several = some.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select(F.col("id").alias("b"))
    own = some.join(several, some.id == several.b).select("fp", "b").distinct().join(classes.select("fp", F.col("id").alias("a")), "fp").select("a", "b")
    labels = components(pairs.unionByName(own), "simhash-components")
    known = classes.join(labels, classes.id == labels.node, "left").select("fp", F.coalesce("component", "id").alias("c"))
    out = made.join(known, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.col("c"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
