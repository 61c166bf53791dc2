"""Quality rules on repetition: rolling hashes of several n-gram lengths in numpy.

For each text, from 64-bit hashes of its words: which part of its characters lies in
n-grams that occur twice or more (n from 5 to 10), in the most frequent n-gram (n from 2 to
4), and in lines equal to an earlier line.  A window of n words repeats only if its first
n - 1 words do, so each length looks only at what the length before has left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusql.llm.vectext import SPACED, Block, Words, blocks, chain, mix, sums

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits beyond which a text is rejected.

    The repetition limits are those published for MassiveText (Rae et al. 2021, table A1),
    each with an allowance for one sentence of ``sentence`` words that is said twice:
    ``2 * sentence / n_words`` of the text, ``allowance`` at most.  It matters in short
    texts only: one such sentence is 40 % of a text of 100 words and 1 % of one of 4,000.
    ``min_words`` and ``max_repeat_words`` are the base rules.  ``max_symbols``: signs of
    ``#*$%&|<>`` a word.
    """

    min_words: int = 50
    max_repeat_words: float = 0.5
    # The published limits.
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    duplicate: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    max_dup_lines: float = 0.30
    max_dup_line_chars: float = 0.20
    max_symbols: float = 0.10
    sentence: int = 20
    allowance: float = 0.25


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window how often it occurs in its text, and a number for what it is."""
    key = mix(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse], inverse


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all lines, and which equal an earlier line of their text."""
    newline = np.flatnonzero(block.data == 10)
    start = np.concatenate([block.offsets[:-1], newline + 1])
    doc = np.concatenate([np.arange(block.n), np.searchsorted(block.offsets, newline, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = block.offsets[doc + 1].copy()
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    end[inner] = start[inner + 1] - 1
    run, down = block.prefix_hash(block.data)
    key = mix(mix((run[end] - run[start]) * down[start]) ^ ((end - start).astype(np.uint64) << np.uint64(32)) ^ mix(doc.astype(np.uint64)))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return start, end, doc, first[inverse] != np.arange(len(key))


def _most_frequent(w: Words, size: np.ndarray, alive: np.ndarray, which: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Characters of each text in its most frequent n-gram (by occurrences times characters; overlaps count once)."""
    out = np.zeros(w.block.n)
    if not len(alive):
        return out
    doc = w.doc[alive]
    order = np.lexsort((alive, -weight, doc))  # of equal ones the first in the text
    first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
    best = np.full(w.block.n, -1)
    best[doc[first]] = which[first]
    at = alive[which == best[doc]]
    covered = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + k, -1)
    covered = np.cumsum(covered[:-1]) > 0
    return np.bincount(w.doc[covered], weights=size[covered], minlength=w.block.n)


def measure(block: Block, rules: Rules) -> dict[str, np.ndarray]:
    """All figures of each text of a block."""
    w = Words(block, SPACED)
    n = block.n
    out: dict[str, np.ndarray] = {"n_words": w.count.astype(np.int64)}
    points = (block.data & 0xC0) != 0x80
    out["word_chars"] = sums(points & w.inside, block.offsets)
    out["n_symbols"] = sums(_SYMBOL[block.data], block.offsets)
    start, end, doc, again = _lines(block)
    has_word = np.zeros(len(start), bool)
    if len(w.start):
        i = np.searchsorted(w.start, start)
        has_word = (i < len(w.start)) & (w.start[np.minimum(i, len(w.start) - 1)] < end)
    run = np.concatenate([[0], np.cumsum(points & w.inside)])
    again &= has_word
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n).astype(np.int64)
    lines = np.bincount(doc[has_word], minlength=n)
    line_chars = np.bincount(doc[again], weights=(run[end] - run[start])[again], minlength=n)
    size = (run[w.end] - run[w.start]).astype(np.int64)  # code points of each word
    total = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(lines, 1)
    out["dup_line_char_share"] = line_chars / total
    size_run = np.concatenate([[0], np.cumsum(size)])

    alive = np.arange(len(w.hash))
    for k in range(2, 11):
        alive = alive[alive + k <= len(w.hash)]
        alive = alive[w.doc[alive] == w.doc[alive + k - 1]]
        h = np.zeros(len(alive), np.uint64)
        for j in range(k):
            h = h * np.uint64(0x2545F4914F6CDD1D) + w.hash[alive + j]
        count, which = _repeated(w.doc[alive], h)
        alive, count, which = alive[count > 1], count[count > 1], which[count > 1]
        chars = size_run[alive + k] - size_run[alive]
        covered = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(covered, alive, 1)
        np.add.at(covered, alive + k, -1)
        covered = np.cumsum(covered[:-1]) > 0
        if k == 3:
            out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n).astype(np.int64)
        if k in rules.top:
            out[f"top_{k}_share"] = _most_frequent(w, size, alive, which, chars * count, k) / total
        if k in rules.duplicate:
            out[f"dup_{k}_share"] = np.bincount(w.doc[covered], weights=size[covered], minlength=n) / total
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > round(100 * rules.max_repeat_words) * out["n_words"])
    bad = out["base_failed"].copy()
    more = np.minimum(rules.allowance, 2 * rules.sentence / np.maximum(out["n_words"], 1))
    for k, most in rules.top.items():
        bad |= out[f"top_{k}_share"] > most + more
    for k, most in rules.duplicate.items():
        bad |= out[f"dup_{k}_share"] > most + more
    bad |= (out["dup_line_share"] > rules.max_dup_lines + more) | (out["dup_line_char_share"] > rules.max_dup_line_chars + more)
    bad |= out["n_symbols"] > rules.max_symbols * out["n_words"]
    out["kept"] = ~bad
    return out


def columns(rules: Rules) -> dict[str, str]:
    """The columns that the operator adds, with their types."""
    shares = [f"top_{k}_share" for k in sorted(rules.top)] + [f"dup_{k}_share" for k in sorted(rules.duplicate)] + ["dup_line_share", "dup_line_char_share"]
    return dict.fromkeys(FIELDS, "long") | dict.fromkeys(shares, "double") | dict.fromkeys(("base_failed", "kept"), "boolean")


def quality_rules(df: DataFrame, rules: Rules = Rules(), *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the figures and verdicts of ``columns(rules)``.

    One pass without a shuffle.  Null and empty texts have no words, fail the base rules and
    are not kept; equal rows get equal figures.  A column of ``df`` that has the name of a
    figure is replaced by it; the others pass through.
    """
    added = columns(rules)
    carried = [c for c in (df.columns if keep is None else keep) if c not in added]
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], text.alias("t"))
    fields = [f.simpleString().split(":", 1) for f in rows.schema.fields[:-1]]
    schema = ", ".join([f"{a} {b}" for a, b in fields] + [f"`{k}` {v}" for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(b.num_columns - 1)
            parts = [measure(block, rules) for block in blocks(t)]
            figures = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[v]) for k, v in added.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *figures], names=[*b.schema.names[:-1], *added])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *added)
