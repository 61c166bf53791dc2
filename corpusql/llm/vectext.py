"""Words, hashes and windows of many texts at once in numpy.

Texts are handled as UTF-8 bytes.  All separators and all letters that are changed are
ASCII, so byte-wise work gives the same words as character-wise work.  A block holds whole
texts, about ``BLOCK`` bytes together; memory is some 40 times the larger of ``BLOCK`` and
the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``n`` positions."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, BLOCK)
        with np.errstate(over="ignore"):
            up, down = np.full(m, _BASE), np.full(m, np.uint64(_inverse(int(_BASE))))
            up[0] = down[0] = 1
            found = np.cumprod(up), np.cumprod(down)
        if m > 8 * BLOCK:
            return found
        _powers = found
    return _powers


def table(separators: bytes = b" \t\n\v\f\r", lower: bool = False, word: bytes | None = None) -> np.ndarray:
    """For each byte 0 if it separates words, else the byte as it counts in a word (254, never in UTF-8, for a zero byte).

    ``word``: the ASCII bytes that belong to words (after lower-casing); bytes from 0x80 on
    always do.  Without it, all but ``separators`` do.
    """
    out = np.arange(256, dtype=np.uint8)
    out[0] = 254
    if lower:
        out[65:91] += 32
    if word is not None:
        keep = np.zeros(256, bool)
        keep[list(word)] = True
        keep[128:254] = True
        out[~keep[out]] = 0
    else:
        out[list(separators)] = 0
    return out


SPACED = table()
SPACED_LOWER = table(lower=True)
ALNUM_LOWER = table(lower=True, word=b"0123456789abcdefghijklmnopqrstuvwxyz")


class Block:
    """Whole texts: ``data`` their bytes, ``offsets`` where each starts (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()

    def prefix_hash(self, bytes_as: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The running polynomial hash (one more entry than bytes) and the inverse powers."""
        up, down = _powers_to(len(self.data) + 1)
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_LETTERS[bytes_as] * up[: len(self.data)], out=run[1:])
        return run, down

    def spans_of(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of ``inside`` that don't cross texts."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty(len(inside), bool)
        before[0] = False
        before[1:] = inside[:-1]
        cut = self.offsets[:-1]
        cut = cut[cut < len(inside)]
        before[cut] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        return starts, np.flatnonzero(inside & ~after) + 1

    def words(self, by: np.ndarray) -> Words:
        return Words(self, by)


class Words:
    """The words of a block: ``start``, ``end`` (bytes), ``doc`` (row in the block), ``hash``."""

    def __init__(self, block: Block, by: np.ndarray):
        as_read = by[block.data]
        inside = as_read != 0
        self.block = block
        self.start, self.end = block.spans_of(inside)
        self.inside = inside
        self.first = np.searchsorted(self.start, block.offsets)  # of each text, one more at the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(block.n), self.count)
        run, down = block.prefix_hash(as_read)
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of the first word) and hashes of all runs of ``k`` words within a text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, chain(self.hash, k)[at]


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """For each position the hash of ``k`` consecutive hashes from there."""
    n = len(hashes) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        h *= np.uint64(0x2545F4914F6CDD1D)
        h += hashes[j : j + n]
    return mix(h)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """Cuts a string column into blocks; null counts as empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = pc.fill_null(chunk, "")
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, offs, data = chunk.buffers()
        o = np.frombuffer(offs, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i, n = 0, len(chunk)
        while i < n:
            j = max(int(np.searchsorted(o, o[i] + limit, "right")) - 1, i + 1)
            yield Block(raw[o[i] : o[j]], o[i : j + 1] - o[i], i)
            i = j


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``offsets``."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return np.diff(run[offsets])
