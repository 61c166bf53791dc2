"""Benchmark decontamination by winnowing.

Of every ``gap`` successive k-grams of words the one with the least hash (the rightmost of
equals) is a fingerprint, in documents and benchmark items alike; so each shared run of
``span = k + gap - 1`` words has a fingerprint that both sides selected.  Fingerprints of
documents are looked up among those of the benchmark, and each hit is extended: the runs of
``span`` words around it are compared as wholes.  Items shorter than ``span`` words are one
run each, and documents are winnowed for their lengths with a gap of 1.

The benchmark is taken in blocks of bounded size, each sent to all executors in turn, so
documents are never shuffled and a benchmark of any size works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusql.llm.common import materialise
from corpusql.llm.vectext import ALNUM_LOWER, Words, blocks, chain


def winnow(grams: np.ndarray, ok: np.ndarray, gap: int) -> np.ndarray:
    """Positions of the fingerprints; ``ok``: starts of windows of ``gap`` grams within one text."""
    if not len(ok):
        return ok
    best, where = grams[ok], ok.copy()
    for j in range(1, gap):
        g = grams[ok + j]
        less = g <= best
        best = np.where(less, g, best)
        where[less] = ok[less] + j
    return np.unique(where)


class Index:
    """The runs of a block of benchmark items and their fingerprints."""

    def __init__(self, items: list[tuple[str, str | None]], span: int, k: int):
        self.span, self.k, self.gap = span, k, span - k + 1
        names = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(names)}
        self.names = names
        prints: list[np.ndarray] = []
        runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        column = pa.array([t for _, t in items], pa.large_string())
        for b in blocks(column):
            w = Words(b, ALNUM_LOWER)
            owner = np.array([number[i] for i, _ in items[b.first : b.first + b.n]])
            at, h = w.windows(span)
            if len(at):
                prints.append(chain(w.hash, k)[winnow(chain(w.hash, k), at, self.gap)])
                runs.setdefault(span, []).append((h, owner[w.doc[at]]))
            for n in np.unique(w.count[(w.count > 0) & (w.count < span)]).tolist():
                of = np.flatnonzero(w.count == n)
                runs.setdefault(n, []).append((chain(w.hash, n)[w.first[of]], owner[of]))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.runs = {}
        for n, parts in runs.items():
            h, o = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
            self.runs[n] = h[new], o[new]

    @staticmethod
    def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
        i = np.searchsorted(table, h)
        return (i < len(table)) & (table[np.minimum(i, len(table) - 1)] == h) if len(table) else np.zeros(len(h), bool)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and item of each run of an item in the texts."""
        starts, sizes, owners = [], [], []
        for n, (table, owner) in self.runs.items():
            if n == self.span:
                at, _ = w.windows(self.span)
                grams = chain(w.hash, self.k)
                hit = winnow(grams, at, self.gap)
                hit = hit[self._among(grams[hit], self.prints)]
                near = np.unique((hit[:, None] - np.arange(self.gap)[None, :]).ravel())
                near = near[(near >= 0) & (near + n <= len(w.hash))]
                at = near[w.doc[near] == w.doc[near + n - 1]]
                h = np.zeros(len(at), np.uint64)
                if len(at):
                    h = chain_at(w.hash, at, n)
            else:
                at, h = w.windows(n)
            found = self._among(h, table)
            at, h = at[found], h[found]
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            count = hi - lo
            each = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            starts.append(np.repeat(at, count))
            owners.append(owner[each])
            sizes.append(np.full(len(each), n))
        if not starts:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(owners)


def chain_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``chain`` at some positions only."""
    from corpusql.llm.vectext import mix

    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x2545F4914F6CDD1D) + hashes[at + j]
    return mix(h)


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5, block_bytes: int = 32 << 20, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with what it shares with the benchmark.

    Added: ``n_words``; ``hit_spans`` (array<long>: first word and end word of each maximal
    hit, flat, counted from 0); ``n_hit`` (words in them); ``items`` (array<string>, the
    item ids sorted as strings, a null id as ``null``); ``n_items``; ``items_sha256`` (of
    them joined by commas); ``contaminated``.  Columns of these names in ``df`` are
    replaced.  Null texts have no words; items without words match nothing; repeated items
    count once; an empty benchmark leaves every row clean.
    """
    added = {"n_words": "long", "hit_spans": "array<long>", "n_hit": "long", "items": "array<string>", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}
    carried = [c for c in (df.columns if keep is None else keep) if c not in added]
    item = F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null"))
    text = F.coalesce(F.col(f"`{item_text_col}`"), F.lit(""))
    bench = benchmark.select(item.alias("i"), text.alias("t")).distinct()
    size = bench.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{text_col}`").cast("string").alias("t"), F.lit(None).cast("long").alias("w"), F.array().cast("array<long>").alias("h"), F.array().cast("array<string>").alias("n"))
    schema = rows.schema
    sc = df.sparkSession.sparkContext
    for b in range(n_blocks):
        # Bounded by block_bytes: a block of the benchmark, never documents.
        part = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect()
        index = sc.broadcast(Index([(r["i"], r["t"]) for r in part], span, k))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = batch.num_columns
                counts, spans, items = [], batch.column(m - 2).to_pylist(), batch.column(m - 1).to_pylist()
                for block in blocks(batch.column(m - 4)):
                    w = Words(block, ALNUM_LOWER)
                    counts += w.count.tolist()
                    start, n, owner = index.value.occurrences(w)
                    order = np.argsort(start, kind="stable")
                    start, n, owner = start[order], n[order], owner[order]
                    doc = w.doc[start] if len(start) else start
                    found, first = np.unique(doc, return_index=True)  # runs are in order of the texts
                    for d, a, z in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(doc)]):
                        own = slice(a, z)
                        s = (start[own] - w.first[d]).tolist()
                        e = (start[own] + n[own] - w.first[d]).tolist()
                        row = block.first + d
                        spans[row] = merged(spans[row], s, e)
                        items[row] = sorted({*items[row], *(index.value.names[i] for i in np.unique(owner[own]).tolist())})
                yield pa.RecordBatch.from_arrays([*batch.columns[: m - 3], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

        rows = rows.mapInArrow(run, schema)
        if b < n_blocks - 1:
            rows = materialise(rows, "decontaminate")
    n_hit = F.aggregate(F.transform("h", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    joined = F.array_join("n", ",")
    values = [F.coalesce("w", F.lit(0).cast("long")), F.col("h"), n_hit, F.col("n"), F.size("n").cast("long"), F.sha2(joined, 256), F.size("n") > 0]
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *[v.alias(a) for v, a in zip(values, added)])


def merged(flat: list[int], starts: list[int], ends: list[int]) -> list[int]:
    """Maximal intervals that cover the flat intervals and the new ones."""
    out: list[int] = []
    for s, e in sorted([*zip(flat[::2], flat[1::2]), *zip(starts, ends)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
#: The figures of each document in DuckDB's SQL, from all runs of words without fingerprints.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
o AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, s IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
