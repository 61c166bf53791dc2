"""Near-duplicates: MinHash with tensored banding, verified on full shingle sets.

Two collections of ``m`` short keys are made for each set (a key joins ``width`` minima);
each of the ``m * m`` pairs of one key from either collection is a table key.  So
``2 * m * width`` minima serve ``m * m`` tables of ``2 * width`` minima each, about the
square root of what tables of their own would need.  Two sets of similarity ``s`` meet in
a table with probability ``(1 - (1 - s ** width) ** m) ** 2``: 0.99990 at 0.75 and 0.99999
at 0.8 with the defaults.

Equal sets are first made one class, so copies cost nothing further.  In each bucket of a
table the classes are ordered by further minima, and each is paired with its ``neighbours``
successors and with the bucket's smallest id: likes stand side by side, all pairs of a
bucket of up to ``neighbours + 1`` classes are taken, and a bucket of any size gives pairs
in proportion to its size.  Every pair is confirmed on its two full sets before it links.

What larger buckets leave out is made up for exactly (``crowded`` and ``rest``): where such
a bucket still holds several components, every pair across them that can be alike at all is
found by the shingles that few of these classes have, or, if it can do without them, by
pairing the bucket in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusql.llm.common import fits, materialise
from corpusql.llm.vectext import SPACED_LOWER, Block, Words, blocks, chain, mix


WORDS = 16  # of 64 bits that tell which shingles a crowded text has


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, by text; a text of fewer than ``k`` words is one."""
    w = Words(block, SPACED_LOWER)
    at, h = w.windows(k)
    doc = w.doc[at]
    for n in np.unique(w.count[(w.count > 0) & (w.count < k)]).tolist():
        few = np.flatnonzero(w.count == n)
        doc = np.concatenate([doc, few])
        h = np.concatenate([h, mix(chain(w.hash, n)[w.first[few]] + np.uint64(n))])
    _, first = np.unique(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    first = first[np.argsort(doc[first], kind="stable")]
    return doc[first], h[first]


class Sketcher:
    def __init__(self, k: int, m: int, width: int, seed: int = 11):
        self.k, self.m, self.width = k, m, width
        self.n = 2 * m * width + 8
        self.salts = mix(np.arange(1, self.n + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self.odds = mix(self.salts) | np.uint64(1)

    def __call__(self, block: Block) -> tuple[np.ndarray, ...]:
        """Set size, two set hashes, the two collections of keys, and the ordering minima."""
        doc, h = shingles(block, self.k)
        size = np.bincount(doc, minlength=block.n).astype(np.int64)
        has = np.flatnonzero(size)
        cut = (np.cumsum(size) - size)[has]
        least = np.zeros((block.n, self.n), np.uint64)
        sets = np.zeros((2, block.n), np.uint64)
        if len(has):
            for r in range(self.n):
                x = (h ^ self.salts[r]) * self.odds[r]
                x ^= x >> np.uint64(29)
                least[has, r] = np.minimum.reduceat(x * self.odds[r - 1], cut)
            for j in range(2):
                sets[j, has] = np.add.reduceat(mix(h * self.odds[j] + self.salts[j]), cut)
        keys = least[:, : 2 * self.m * self.width].reshape(block.n, 2 * self.m, self.width)
        short = np.zeros((block.n, 2 * self.m), np.uint64)
        for j in range(self.width):
            short = short * np.uint64(0x2545F4914F6CDD1D) + mix(keys[:, :, j])
        short = mix(short)
        bytes_ = mix(least[:, -8:]) & np.uint64(0xFF)
        order = np.zeros(block.n, np.uint64)
        for j in range(8):
            order = (order << np.uint64(8)) | bytes_[:, j]
        return size, sets[0].view(np.int64), sets[1].view(np.int64), short[:, : self.m].view(np.int64), short[:, self.m :].view(np.int64), order.view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(np.ascontiguousarray(x).ravel()))


def sketch(rows: DataFrame, k: int, m: int, width: int) -> DataFrame:
    """``rows`` (id, t) to (id, n, s1, s2, u, v, o)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher(k, m, width)
        for b in batches:
            for block in blocks(b.column(1)):
                size, s1, s2, u, v, o = make(block)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(block.first, block.n), pa.array(size), pa.array(s1), pa.array(s2), _lists(u), _lists(v), pa.array(o)], names=["id", "n", "s1", "s2", "u", "v", "o"])

    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, u array<long>, v array<long>, o long")


def members(classes: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``key, id, o, z, least``: the classes of every bucket that holds two or more.

    ``z`` is the bucket's number of classes and ``least`` its smallest id, both from an
    aggregation that combines before it deals; most keys are met once and go no further.  Of
    buckets with the same classes (as two classes meet in many tables) one stands for all.
    """
    keyed = classes.select("id", "o", F.posexplode("u").alias("i", "x"), "v").select("id", "o", "i", "x", F.posexplode("v").alias("j", "y"))
    # Each table orders its buckets from another of the eight ordering minima.
    order = F.expr("shiftleft(o, 8 * ((i + 3 * j) % 8)) | shiftrightunsigned(o, 64 - 8 * ((i + 3 * j) % 8))")
    keyed = keyed.select(F.xxhash64("i", "j", "x", "y").alias("key"), "id", order.alias("o"))
    each = keyed.groupBy("key").agg(F.count("*").alias("z"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("who")).where("z > 1")
    shared = materialise(each.groupBy("z", "least", "who").agg(F.min("key").alias("key")).select("key", "z", "least"), "buckets")
    small = fits(shared, F.lit(24), broadcast_bytes)
    return materialise(keyed.join(F.broadcast(shared) if small else shared, "key"), "members")


def candidates(met: DataFrame, neighbours: int, run: int = 512) -> DataFrame:
    """Distinct pairs ``a < b`` of class ids that meet in a table, of larger buckets only a part.

    A bucket is ordered in parts of about ``run`` classes, cut by the first bits of the order,
    so a crowd is dealt over many tasks; only pairs across a cut are left out by that.
    """
    bits = F.greatest(F.ceil(F.log2(F.col("z") / run)), F.lit(0)).cast("int")
    part = F.when(bits > 0, F.expr("shiftrightunsigned(o, 64 - bits)")).otherwise(F.lit(0).cast("long"))
    w = Window.partitionBy("key", "part").orderBy("o", "id")
    others = [F.lead("id", d).over(w) for d in range(1, neighbours + 1)] + [F.col("least")]
    pairs = met.withColumn("bits", bits).withColumn("part", part).select("id", F.array(*others).alias("p")).select("id", F.explode("p").alias("q")).where("q is not null and q <> id")
    return pairs.select(F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b")).distinct()


def crowded(met: DataFrame, labels: DataFrame, neighbours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where buckets of more than ``neighbours + 1`` classes hold several components.

    Returns ``key, id, c`` of all classes in larger buckets; ``key, id, c`` of those that are
    not of their bucket's largest component, in the buckets that have several; and ``c``, all
    components in these buckets.
    """
    c = labels.select(F.col("node").alias("id"), "component")
    named = materialise(met.where(F.col("z") > neighbours + 1).join(c, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), "crowd-members")
    sizes = materialise(named.groupBy("key", "c").count(), "crowd-sizes")
    main = sizes.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("count", "c")).alias("m")).where("n > 1").select(F.col("key").alias("of"), F.col("m.c").alias("main"))
    main = materialise(main, "crowd-main")
    odd = named.join(main, (F.col("key") == F.col("of")) & (F.col("c") != F.col("main"))).select("key", "id", "c")
    beside = sizes.join(main, F.col("key") == F.col("of")).groupBy("c").agg(F.lit(1).alias("one")).select("c")
    return named, materialise(odd, "crowd-odd"), beside


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """``texts`` (id, c, t) to (id, c, r, n, h, x): a row a shingle, ``r`` the text's own number, ``n`` its set's size.

    ``x``, in the first row of a text and else empty, has a bit set for each shingle's place of 64 * WORDS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(3)):
                doc, h = shingles(block, k)
                n = np.bincount(doc, minlength=block.n)
                place = mix(h ^ np.uint64(0x5851F42D4C957F2D))
                x = np.zeros((block.n, WORDS), np.uint64)
                np.bitwise_or.at(x, (doc, (place >> np.uint64(6)).astype(np.int64) % WORDS), np.uint64(1) << (place & np.uint64(63)))
                first = np.diff(doc, prepend=-1) > 0
                cut = np.concatenate([[0], np.cumsum(first * WORDS)]).astype(np.int32)
                bits = pa.ListArray.from_arrays(pa.array(cut), pa.array(x[doc[first]].view(np.int64).ravel()))
                at = pa.array(doc + block.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(n[doc].astype(np.int64)), pa.array(h.view(np.int64)), bits], names=["id", "c", "r", "n", "h", "x"])

    return texts.select("id", "c", F.xxhash64("id", "t").alias("r"), "t").mapInArrow(run, "id long, c long, r long, n long, h long, x array<long>")


def rest(named: DataFrame, odd: DataFrame, beside: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int, few: int) -> DataFrame:
    """All pairs ``a < b`` of different components that met in a larger bucket and can be alike.

    Looked at are all texts of the components that stand beside another in such a bucket.  A
    shingle is rare if at most ``few`` of them have it, and each text has some number ``f`` of
    frequent ones.  Two sets share no more than the rare shingles they share and the smaller
    ``f``; where this cannot reach the limit the pair is not alike.  Pairs that share rare
    shingles meet by them; the others reach it only with the frequent ones, and are taken
    from their buckets, each class outside the bucket's largest component with all others,
    unless too many bits of one are not in the other.
    """
    c = labels.select(F.col("node").alias("id"), F.col("component").alias("c"))
    own = texts.select("id").distinct().join(c, "id", "left").select("id", F.coalesce("c", "id").alias("c"))
    of = own.join(beside, "c", "left_semi")
    rows = materialise(shingle_rows(texts.join(of, "id").dropDuplicates(["id", "t"]), k), "crowd-shingles")
    rare = rows.groupBy("h").count().where(F.col("count").between(1, few)).select("h")
    rare = materialise(rows.drop("x").join(rare.hint("merge"), "h"), "crowd-rare")
    each = rows.groupBy("id", "c", "r").agg(F.first("n").alias("n"), F.max("x").alias("x")).join(rare.groupBy("r").agg(F.count("*").alias("own")), "r", "left")
    each = materialise(each.select("id", "c", "r", "n", "x", (F.col("n") - F.coalesce("own", F.lit(0))).alias("f")), "crowd-texts")

    def reaches(shared) -> F.Column:
        return (100 + percent) * shared >= percent * (F.col("na") + F.col("nb"))

    def lacks(x: str, y: str) -> F.Column:
        """The bits of ``x`` that ``y`` has not: each stands for a shingle or more that isn't shared."""
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c in ("h", "key") else c + x) for c in df.columns])

    apart = (F.col("ia") < F.col("ib")) & (F.col("ca") != F.col("cb"))
    by = rare.join(each.select("r", "f"), "r").select("h", F.col("id").alias("i"), "c", "r", "n", "f")
    a, b = side(by, "a"), side(by, "b")
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    shared = a.join(b.hint("merge"), (a.h == b.h) & apart & sized).groupBy("ia", "ib", "ra", "rb", "na", "nb", "fa", "fb").count()
    shared = shared.where(reaches(F.col("count") + F.least("fa", "fb"))).select(F.col("ia").alias("a"), F.col("ib").alias("b"))

    # Without rare ones a pair needs 100 f >= percent * n on both sides, so only buckets in
    # which a class outside the largest component has that are read.
    full = each.where(100 * F.col("f") >= percent * F.col("n")).select(F.col("id").alias("i"), "n", "f", "x")
    held = materialise(odd.withColumnRenamed("id", "i").join(full, "i"), "crowd-odd-full")
    others = named.join(held.select("key").distinct(), "key", "left_semi").withColumnRenamed("id", "i").join(full, "i")
    a, b = side(held.select("key", "i", "c", "n", "f", "x"), "a"), side(others.select("key", "i", "c", "n", "f", "x"), "b")
    whole = a.join(b.hint("merge"), (a.key == b.key) & (F.col("ca") != F.col("cb")) & reaches(F.least("fa", "fb")) & reaches(F.least(F.col("na") - lacks("xa", "xb"), F.col("nb") - lacks("xb", "xa"))))
    whole = whole.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return shared.unionByName(whole).distinct()


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike: ``100 * |A & B| >= percent * |A | B|``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[list[np.ndarray]] = [[], []]
            for side in (0, 1):
                for block in blocks(batch.column(2 + side)):
                    doc, h = shingles(block, k)
                    sets[side] += np.split(h, np.cumsum(np.bincount(doc, minlength=block.n))[:-1])
            alike = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                alike.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    # The same plan at every size: texts are dealt by id and merged, never sent to all executors.
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """``node, component``: the smallest node each is connected with, by alternating star steps.

    Each round joins every node's edges to the least node it knows (large star, then small
    star), until nothing changes; the published bound is about log(n) ** 2 rounds.  Tables
    between rounds are written, so lineage stays short.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), what)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("l")).select("a", F.least("a", "l").alias("l"))
        large = both.where("b > a").join(least, "a").select(F.col("l").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("l"))
        joined = large.join(least, "b")
        small = joined.select(F.col("l").alias("x"), F.col("a").alias("y")).unionByName(joined.select(F.col("l").alias("x"), F.col("b").alias("y")))
        edges = materialise(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), what)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        state = now


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, m: int = 12, width: int = 2, neighbours: int = 3, few: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Words are split at white space after lower-casing A-Z.  ``component_id`` is the smallest
    id that links lead to, the document's own included, and ``kept`` tells whether that is
    its own.  Texts without words, and rows with a null id (component null, kept), are
    linked with nothing.  Equal rows give equal results; rows with one id and different
    texts count as one document with several texts.  Other columns are not read.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    made = materialise(sketch(rows, k, m, width), "sketches")
    some = made.where("id is not null and n > 0")
    classes = materialise(some.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("u").alias("u"), F.first("v").alias("v"), F.first("o").alias("o")), "classes")
    buckets = members(classes, broadcast_bytes)
    pairs = materialise(candidates(buckets, neighbours), "pairs")
    # Only texts that some pair needs are moved: their ids are sent to all executors if they
    # are within broadcast_bytes, else texts and ids are dealt by id.
    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    small = fits(needed, F.lit(16), broadcast_bytes)
    texts = materialise(rows.where("id is not null").join(F.broadcast(needed) if small else needed, "id", "left_semi"), "needed-texts")
    first = components(verify(spanning(pairs), texts, k, percent), "round1")
    left = across(pairs, first).join(spanning(pairs), ["a", "b"], "left_anti")
    more = verify(left, texts, k, percent)
    links = more.unionByName(first.select(F.col("component").alias("a"), F.col("node").alias("b")))
    second = materialise(components(links, "round2"), "round2")
    # Crowds: what is still apart in the larger buckets, without the pairs that were verified.
    named, odd, beside = crowded(buckets, second, neighbours)
    left = materialise(rest(named, odd, beside, second, texts, k, percent, few).join(pairs, ["a", "b"], "left_anti"), "crowd-pairs")
    found = materialise(verify(left, texts, k, percent), "crowd-links")
    final = second if found.isEmpty() else components(found.unionByName(second.select(F.col("component").alias("a"), F.col("node").alias("b"))), "round3")
    ids = some.select("id", "s1", "s2").join(classes.select("s1", "s2", F.col("id").alias("rep")), ["s1", "s2"])
    linked = ids.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("c"))
    out = made.select("id", "n").join(linked, "id", "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def spanning(pairs: DataFrame) -> DataFrame:
    """Of each class's pairs the one with the smallest and the one with the largest smaller partner.

    These few are verified first; most groups of copies are connected by them, and of the
    other pairs only those between different components still matter.
    """
    return pairs.groupBy("b").agg(F.array_distinct(F.array(F.min("a"), F.max("a"))).alias("p")).select(F.explode("p").alias("a"), "b")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends have different components so far."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    j = pairs.join(a, "a", "left").join(b, "b", "left")
    return j.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


#: All links and components in DuckDB's SQL, from all pairs with a common shingle: for small tables with unique ids.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a),
m AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id
"""
