"""Token ids of whole texts with the ``tokenizers`` library, words remembered between texts.

The library spends most of its time on regular expressions and on words it has seen.  The
fast way below gives the library's ids: for a vocabulary whose pre-tokeniser drops white
space and never joins across it, the ids of a text are those of its words in order, so each
word (its ASCII letters in either case, known by a 64-bit hash) is encoded once and looked
up afterwards.  A full stop or comma between a letter or digit and white space is a word of
its own.  Words of Latin letters, digits and ASCII signs are encoded many at a time by the
library's model alone, all others one at a time by the whole library; a text with unusual white space or
with the marks of special tokens is given to it whole, as is every text where the
vocabulary is of any other kind.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from corpusql.llm.vectext import Block, blocks, mix, sums, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces into which the vocabulary's pattern cuts a word: Latin letters that lower-case to one
#: letter and stay as they are under NFC (so without U+0130), single digits, runs of ASCII signs
#: other than the apostrophe.
_PIECES = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+|[0-9]|[!-&(-/:-@\\[-`{-~]+").findall
_TABLE = table(lower=True)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
#: First bytes of characters that may be unusual white space, and what then follows in UTF-8.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class Encoder:
    """``encode(column)`` gives one uint32 array a text, the ``end`` id appended where given.

    ``remembered``: words kept at most; beyond it the memory starts anew, which changes
    speed and not results.
    """

    def __init__(self, path: str, end: int | None = None, remembered: int = 1_500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.whole = Tokenizer.from_str(text)
        self.end = np.array([] if end is None else [end], np.uint32)
        self.remembered = remembered
        suffix = spec["model"].get("end_of_word_suffix")
        steps = json.dumps(spec.get("pre_tokenizer"))
        self.fast = bool(suffix) and '"Removed"' in steps and '"ByteLevel"' in steps
        if self.fast:
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "post_processor": None}))
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.is_end = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.is_end[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self._forget()

    def _forget(self) -> None:
        # Sorted hashes with the place of each word's ids; 20 bytes a word beside the ids.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 18, np.uint32), 0, 0
        self.at, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of new words whose ids these are, one word after the other."""
        n, m, k = self.n, len(ids), len(lengths)
        while self.used + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + k > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        self.pool[self.used : self.used + m] = ids
        self.length[n : n + k] = lengths
        self.at[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.used += m
        self.n += k
        return np.arange(n, n + k, dtype=np.int32)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encodes new words; their places."""
        places = np.full(len(words), -1, np.int32)
        plain = [(i, p) for i, w in enumerate(words) if "".join(p := _PIECES(w)) == w]
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            pieces = np.array([len(p) for _, p in part])
            ids = np.array(self.plain.encode(" ".join([x for _, p in part for x in p]).lower(), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.is_end[ids]) + 1
            if len(cuts) == pieces.sum():
                places[[i for i, _ in part]] = self._keep(ids, np.diff(cuts[np.cumsum(pieces) - 1], prepend=0))
        rest = np.flatnonzero(places < 0)
        if len(rest):
            each = [self._library(words[i]) for i in rest.tolist()]
            places[rest] = self._keep(np.concatenate(each), np.array([len(x) for x in each]))
        return places

    def _words(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words, split-off stops included."""
        data = block.data
        as_read = _TABLE[data]
        inside = as_read != 0
        start, end = block.spans_of(inside)
        last = end - 1
        long = end - start >= 2
        before = data[np.maximum(last - 1, 0)]
        two = data[np.maximum(last - 2, 0)]
        letter = _ALNUM[before] | ((before >= 0x80) & (before < 0xC0) & (two >= 0xC3) & (two <= 0xC5) & ~((two == 0xC3) & ((before == 0x97) | (before == 0xB7))) & (last - 2 >= start))
        cut = long & _STOP[data[last]] & letter
        where = np.flatnonzero(cut)
        own = np.insert(start, where + 1, last[where])
        shorter = end.copy()
        shorter[where] -= 1
        ends = np.insert(shorter, where + 1, end[where])
        run, down = block.prefix_hash(as_read)
        return own, ends, mix((run[ends] - run[own]) * down[own])

    def _block(self, block: Block) -> list[np.ndarray]:
        if self.n > self.remembered:
            self._forget()
        start, end, hashes = self._words(block)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        near = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(near, len(self.keys) - 1)] == distinct
        slots = np.zeros(len(distinct), np.int32)
        slots[known] = self.slots[near[known]]
        if len(new := np.flatnonzero(~known)):
            raw = block.data.tobytes()
            slots[new] = self._learn([raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            self.keys = np.insert(self.keys, near[new], distinct[new])
            self.slots = np.insert(self.slots, near[new], slots[new])
        length = self.length[slots][inverse]
        run = np.cumsum(length, dtype=np.int64)
        total = int(run[-1]) if len(run) else 0
        ids = self.pool[np.repeat(self.at[slots][inverse] - run + length, length) + np.arange(total)]
        cuts = np.concatenate([[0], run])[np.searchsorted(start, block.offsets)]
        out = [np.concatenate([ids[a:b], self.end]) for a, b in zip(cuts[:-1], cuts[1:])]
        data = block.data
        odd = np.flatnonzero(_ODD_LEAD[data])
        mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for d in np.unique(np.searchsorted(block.offsets, np.concatenate([odd, mark]), "right") - 1).tolist():
            text = block.text(d)
            if "<|" in text or _ODD.search(text):
                out[d] = np.concatenate([self._library(text), self.end])
        return out

    def encode(self, column: pa.Array | pa.ChunkedArray | list) -> list[np.ndarray]:
        """Ids of each text of a string column (or list); null counts as empty."""
        if isinstance(column, list):
            column = pa.array(column, pa.string())
        if self.fast:
            return [x for b in blocks(column) for x in self._block(b)]
        return [np.concatenate([self._library(t) if t else self.end[:0], self.end]) for t in column.to_pylist()]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end: int | None = None) -> Encoder:
    """One encoder for each vocabulary in this Python process."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]
