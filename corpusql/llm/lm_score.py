"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a row of symbols: words of the vocabulary (all that occur ``least`` times or more
in the training texts), an escape followed by the bytes of a rarer word, and one end.
Symbols are written in binary (a prefix code from the training counts) and every bit of a
code is predicted and mixed:

* three predictors look at hashed contexts.  For words these are the last of the ``anchors``
  most frequent words before (which mostly tells the language), the last word, and the last
  two words; for bytes of a spelled word the last one, three and five bytes of it.  The first
  two predict a bit from the zeros and ones that followed the context and the code so far;
  the third from the symbol that mostly followed its context, as long as the code agrees with
  that symbol's, by how often it did;
* the predictions are added in the logistic domain with weights from a set that a gate
  chooses (the kind of symbol, and how much the second and third context know);
* the weights are adapted online while the text is read: after its words 1, 2, 4, 8, 12, 16
  and so on, every ``step`` words at last;
* the result is refined by an adaptive map from (gate without what the third context knows,
  prediction) to probability, which also learns as the text is read, and averaged with it.

A probability is given to each bit of a prefix code, so the total is the probability of the
text's words; in bits and divided by the bytes it is the total bits per byte.

Weights and map are first fitted on all training texts (equal ones count once).  They are
dealt by their hash into groups of about ``fit_bytes``; of each group the last quarter is
read against the counts of the others, so no text is read against its own counts, and what
the groups have learned is averaged, by how often each weight and each place of the map was
met.  Every text starts from what was fitted: a score depends on the text and the training
texts and on nothing else.

What is counted grows with the training texts: the vocabulary, and the (context, symbol)
pairs, which are counted by sorted runs that are merged by ranges of the context.  The tables
are sized by the numbers of distinct pairs found.  They are files in the shared folder that
each worker reads; the driver sees none of them.  ``table_bytes`` and ``words`` bound what a
worker holds: beyond them slots are shared by more contexts, and rarer words are spelled.
Counts of all other words, however many, are joined for the base score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from corpusql.llm.common import materialise, new_path
from corpusql.llm.token_files import filesystem
from corpusql.llm.vectext import SPACED_LOWER, Block, Words, blocks, mix

SMALL = 1 << 18
CHUNK = 1 << 16  # bits of codes that are read at a time, or those of one step
ESCAPE, END = 0, 1  # symbols before the words
N = 3  # predictors
GATES = 32
MAPS = 8  # of the refinement: four gates share one
BUCKETS = 24
PREFIX = 18, 22  # bits of a hash by which words are found, at least and at most
KEY, SYMBOL = 40, 24  # bits of a context and of a symbol in the key of a pair
SALTS = 4
TOGETHER = 8  # groups of the fit that are read side by side
UNIT = 1 << 12  # of one, in sums over the fit


@dataclass(frozen=True)
class Settings:
    least: int = 2
    words: int = 1 << 22
    anchors: int = 32
    table_bytes: int = 128 << 20
    slots: float = 8  # of a bit table for each pair
    run_slots: float = 1.25  # of the third predictor for each context
    fit_bytes: int = 4 << 20  # of a group of the fit; 0: nothing is fitted
    step: int = 24
    rate: float = 0.004
    map_inertia: float = 30.0
    start: tuple[float, float, float] = (0.3, 0.6, 0.6)


def prefix_code(counts: np.ndarray, longest: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of a prefix code: -log2 of the shares of ``counts`` (0 counts as 1), rounded up, all scaled up as far as they fit."""
    share = np.maximum(counts, 1).astype(float)
    bits = -np.log2(share / share.sum())
    low, high = 0.0, 1.0  # what is taken off before rounding
    for _ in range(20):
        mid = (low + high) / 2
        lengths = np.clip(np.ceil(bits - mid), 1, longest)
        low, high = (mid, high) if np.exp2(-lengths).sum() <= 1 else (low, mid)
    lengths = np.clip(np.ceil(bits - low), 1, longest).astype(np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    size = np.uint64(1) << (np.uint64(longest) - lengths[order].astype(np.uint64))
    at = np.cumsum(size) - size
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = at >> (np.uint64(longest) - lengths[order].astype(np.uint64))
    return codes, lengths


def stretched(pairs: np.ndarray) -> np.ndarray:
    """Zeros and ones, in turns, to the logarithm of their odds in steps of 1/14."""
    zero, one = pairs[0::2].astype(np.float32), pairs[1::2].astype(np.float32)
    return np.clip(np.rint(14 * np.log((one + 0.4) / (zero + 0.4))), -126, 126).astype(np.int8)


def turns(place: np.ndarray, step: int) -> np.ndarray:
    """The step in which each word is scored: weights change between steps."""
    edges = np.array([1, 2, 4, 8, 12, 16])
    return np.where(place < 16, np.searchsorted(edges, place, "right"), len(edges) + np.maximum(place - 16, 0) // step)


def alike(column: pa.Array, limit: int) -> Iterator[tuple[pa.Array, Block]]:
    """Cuts a string column into blocks of texts of about one length, which take about as many steps; and the rows of each."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(size, kind="stable")
    run = np.concatenate([[0], np.cumsum(size[order])])
    i = 0
    while i < len(order):
        j = max(int(np.searchsorted(run, run[i] + limit, "right")) - 1, i + 1)
        rows = pa.array(order[i:j])
        yield rows, next(blocks(column.take(rows), int(run[j] - run[i])))
        i = j


def gates(second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """How much the second and third context know, 0 to 15: sizes over 0.5 and 2, over 0.5 and 1.8."""
    a, b = np.abs(second), np.abs(third)  # in steps of 1/14
    out = np.zeros(len(a), np.uint8)
    for known in (a > 7, a > 28, b > 7, b > 25):
        out += out
        out |= known.view(np.uint8)
    return out


def chunks(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts steps, of which each ends at the next of ``edges`` (in bits), into runs of about ``CHUNK``: what is made of their bits stays in a processor's cache."""
    i, last = 0, len(edges) - 1
    while i < last:
        j = max(int(np.searchsorted(edges, edges[i] + CHUNK, "right")) - 1, i + 1)
        if edges[j] > edges[i]:
            yield i, j
        i = j


def in_turns(turn: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The order by turn, then text (of ``n``), then place."""
    size = len(turn)
    bits = size.bit_length()
    if not size or (int(turn.max()) + 1) * n >= 1 << (63 - bits):
        return np.lexsort((doc, turn))
    key = turn * n + doc  # and the place in the last bits: no two are alike, and values sort faster than places
    key <<= bits
    key |= np.arange(size)
    key.sort()
    key &= (1 << bits) - 1
    return key


def counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    k = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, len(k)))


def with_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts, from sorted runs."""
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")  # merges the runs
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, compressed."""
    planes = lambda x: np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.compress(planes(np.diff(keys, prepend=np.uint64(0))) + planes(counts), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(16, -1)
    whole = lambda planes: np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(whole(x[:8]), dtype=np.uint64), whole(x[8:])


class Model:
    """The vocabulary and its codes; with ``tables`` also what was counted."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare: int, texts: int, byte_counts: np.ndarray, settings: Settings):
        self.s = settings
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.uint64)
        prefix = min(max(PREFIX[0], len(hashes).bit_length()), PREFIX[1])  # about one word shares each
        self.behind = np.uint64(64 - prefix)
        self.start = np.concatenate([[0], np.cumsum(np.bincount((self.hashes >> self.behind).astype(np.int64), minlength=1 << prefix))]).astype(np.int32)
        codes, lengths = prefix_code(np.concatenate([[rare + 1, texts + 1], self.counts]))
        byte_codes, byte_lengths = prefix_code(np.concatenate([byte_counts[:255], [byte_counts.sum() // 6 + 1]]))  # 255, never in UTF-8, ends a word
        self.base = len(codes)
        self.is_anchor = np.zeros(self.base, bool)
        self.is_anchor[np.argsort(-counts[order], kind="stable")[: settings.anchors] + 2] = True
        self.codes = np.concatenate([codes, byte_codes]).astype(np.uint32)
        self.lengths = np.concatenate([lengths, byte_lengths]).astype(np.uint8)
        self.weights = np.repeat(np.array(settings.start, np.float32)[:, None], GATES, 1)
        grid = (np.arange(BUCKETS, dtype=np.float32) + 0.5) * (16.0 / BUCKETS) - 8.0
        self.refined = np.tile(1 / (1 + np.exp(-grid)), MAPS).astype(np.float32)
        self.met = np.zeros(GATES, np.int64), np.zeros(MAPS * BUCKETS, np.int64)  # bits, in the fit
        self.tables: Tables | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among the vocabulary's, -1 for others; by their first bits, of which few words share any."""
        out = np.full(len(hashes), -1, np.int64)
        first = (hashes >> self.behind).astype(np.int64)
        at, end = self.start.take(first), self.start.take(first + 1)
        live = np.flatnonzero(at < end)
        while len(live):
            here = at.take(live)
            hit = self.hashes.take(here) == hashes.take(live)
            out[live[hit]] = here[hit]
            at[live] += 1
            live = live[~hit & (here + 1 < end.take(live))]
        return out

    def symbols(self, block: Block) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words; and of each symbol its number, text, place (in words) and the keys of its three contexts."""
        w = Words(block, SPACED_LOWER)
        at = self.find(w.hash)
        known = at >= 0
        number = np.where(known, at + 2, ESCAPE)
        w.known, w.at = known, at
        # One end after the words of each text.
        to, ends = np.arange(len(at)) + w.doc, w.first[1:] + np.arange(block.n)

        def ended(words: np.ndarray, end: int) -> np.ndarray:
            out = np.full(len(words) + block.n, end, words.dtype)
            out[to] = words
            return out

        number, hashed = ended(number, END), ended(w.hash, 0)
        count = w.count + 1
        doc = np.repeat(np.arange(block.n), count)
        place = np.arange(len(number)) - np.repeat(ends + 1 - count, count)
        last = np.zeros(len(number), np.uint64)
        last[1:] = np.where(doc[1:] == doc[:-1], hashed[:-1], 0)
        before = np.zeros(len(number), np.uint64)
        before[2:] = np.where(doc[2:] == doc[:-2], hashed[:-2], 0)
        # The last frequent word before each symbol.
        seen = np.maximum.accumulate(np.where(self.is_anchor[number], np.arange(len(number)), -1))
        seen = np.concatenate([[-1], seen[:-1]])
        anchor = np.where(seen >= np.arange(len(number)) - place, hashed[np.maximum(seen, 0)], 0)
        # Spelled words: their bytes and a last one, after the escape.
        spelled = np.flatnonzero(number == ESCAPE)
        if not len(spelled):
            return w, number, doc, place, self.contexts(anchor, last, last + mix(before))
        start, size = ended(w.start, 0), ended(w.end - w.start, 0)
        extra = np.zeros(len(number), np.int64)
        extra[spelled] = size[spelled] + 1
        total = len(number) + int(extra.sum())
        into = np.arange(len(number)) + np.cumsum(extra) - extra
        out = np.empty(total, np.int64)
        ctx = np.zeros((N, total), np.uint64)
        out[into] = number
        ctx[0, into], ctx[1, into], ctx[2, into] = anchor, last, last + mix(before)
        where = np.repeat(np.arange(len(number)), extra + 1)
        is_byte = np.ones(total, bool)
        is_byte[into] = False
        to = np.flatnonzero(is_byte)
        i = to - into[where[to]] - 1  # place of the byte in its word
        byte = np.where(i < size[where[to]], SPACED_LOWER[block.data[np.minimum(start[where[to]] + i, max(len(block.data) - 1, 0))]], 255).astype(np.uint64)
        out[to] = self.base + byte.astype(np.int64)
        run = np.zeros(total, np.uint64)
        run[to] = byte + np.uint64(1)
        held = np.zeros(len(to), np.uint64)
        for d in range(1, 6):
            held |= np.where(i >= d, run[np.maximum(to - d, 0)], 0) << np.uint64(9 * (d - 1))
            if d in (1, 3, 5):
                ctx[d // 2, to] = held + np.uint64(1 << 50)
        return w, out, doc[where], place[where], self.contexts(*ctx)

    def contexts(self, *parts: np.ndarray) -> np.ndarray:
        """The keys of contexts, by predictor."""
        return np.stack([mix(x + np.uint64(c + 1)) >> np.uint64(64 - KEY) for c, x in enumerate(parts)])

    def pairs(self, block: Block) -> list[np.ndarray]:
        """The keys of a block's (context, symbol) pairs, for each of the three contexts."""
        _, symbol, _, _, ctx = self.symbols(block)
        return [(ctx[c] << np.uint64(SYMBOL)) | symbol.astype(np.uint64) for c in range(N)]

    def bits(self, symbol: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every bit of the symbols' codes: its place in the code, its value, and a number for the code before it."""
        total = int(length.sum())
        place = np.arange(total, dtype=np.int32)
        place -= np.repeat((np.cumsum(length) - length).astype(np.int32), length)
        # The code after a leading one, less the bits behind this one.
        code = np.repeat(self.codes[symbol] | (np.uint32(1) << length.astype(np.uint32)), length)
        code >>= np.repeat((length - 1).astype(np.uint32), length) - place.view(np.uint32)
        bit = (code & np.uint32(1)).astype(np.uint8)
        code >>= np.uint32(1)
        code *= np.uint32(0x9E3779B1)
        return place, bit, code

    def score(self, block: Block) -> tuple[Words, np.ndarray]:
        """Words, and the natural logarithm of each text's probability."""
        s, n = self.s, block.n
        w, symbol, doc, place, ctx = self.symbols(block)
        # Longest texts first: those that are still being read are the first ones at any time.
        by_length = np.argsort(-w.count, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_length] = np.arange(n)
        doc = rank[doc]
        turn = turns(place, s.step)
        order = in_turns(turn, doc, n)
        symbol, doc, ctx, turn = symbol[order], doc[order], ctx[:, order], turn[order]
        length = self.lengths[symbol].astype(np.int64)
        mind = Mind(self, n)
        cuts = np.searchsorted(turn, np.arange((int(turn[-1]) if len(turn) else -1) + 2))
        first_bit = np.concatenate([[0], np.cumsum(length)])[cuts]
        found = np.zeros(len(symbol), np.float32)
        for i, j in chunks(first_bit):
            part = slice(cuts[i], cuts[j])
            raw, bit = self.bit_inputs(symbol[part], ctx[:, part], length[part])
            key = np.repeat(doc[part] * GATES + np.where(symbol[part] >= self.base, 16, 0), length[part])
            chance = mind.read(raw, bit, key, (first_bit[i : j + 1] - first_bit[i]).tolist())
            np.log(chance, out=chance)
            found[part] = np.add.reduceat(chance, np.cumsum(length[part]) - length[part])
        return w, np.bincount(doc, weights=found, minlength=n)[rank]

    def bit_inputs(self, symbol: np.ndarray, ctx: np.ndarray, length: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of every bit of the symbols' codes the three predictions, stretched, and its value."""
        at, bit, code = self.bits(symbol, length)
        return [self.tables.bit_table(0, ctx[0], length, code), self.tables.bit_table(1, ctx[1], length, code), self.tables.run(self, ctx[2], symbol, length, at, bit)], bit


class Mind:
    """Weights and maps of ``n`` readers that start from the model's and learn as each reads bits of its own."""

    def __init__(self, model: Model, n: int, met: bool = False):
        self.model = model
        self.weights = np.tile(model.weights.T, (n, 1)).ravel()  # by reader, gate and predictor
        self.refined = np.tile(model.refined, n)
        self.met = (np.zeros(n * GATES, np.int64), np.zeros(n * MAPS * BUCKETS, np.int64)) if met else None  # bits

    def read(self, raw: list[np.ndarray], bit: np.ndarray, key: np.ndarray, edges: list[int]) -> np.ndarray:
        """The chance given to each bit as it is; what is learned counts after each step, from one of ``edges`` to the next.

        ``key``: of each bit the reader times ``GATES``, and 16 for a bit of a byte.
        """
        model, s, weights, refined = self.model, self.model.s, self.weights, self.refined
        key = key + gates(raw[1], raw[2])
        row = (key >> 2) * BUCKETS
        # The predictors of a bit lie beside each other, so that sums over one weight don't wait for themselves.
        each, st = np.empty(N * len(key), np.int64), np.empty(N * len(key), np.float32)
        for c in range(N):
            np.multiply(key, N, out=each[c::N])
            each[c::N] += c
            np.multiply(raw[c], np.float32(1 / 14), out=st[c::N])
        y = bit.astype(np.float32)
        chance = np.empty(len(y), np.float32)
        if self.met:
            self.met[0][:] += np.bincount(key, minlength=len(self.met[0]))
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            k, x, t = each[N * a : N * b], st[N * a : N * b], y[a:b]
            z = weights.take(k, mode="clip")
            z *= x
            dot = z[::N] + z[1::N]
            for c in range(2, N):
                dot += z[c::N]
            np.minimum(dot, np.float32(7.99), out=dot)
            np.maximum(dot, np.float32(-7.99), out=dot)
            cell = dot + np.float32(8.0)
            cell *= np.float32(BUCKETS / 16.0)
            cell = cell.astype(np.int64)
            cell += row[a:b]
            np.negative(dot, out=dot)
            np.exp(dot, out=dot)
            dot += np.float32(1.0)
            p = np.reciprocal(dot, out=dot)
            q = refined.take(cell, mode="clip")
            np.add(p, q, out=chance[a:b])
            err = np.subtract(t, p, out=p)
            for c in range(N):
                np.multiply(x[c::N], err, out=z[c::N])
            # Sums over the cells that this step has met.
            change = np.bincount(k, z)
            change *= s.rate
            weights[: len(change)] += change
            off = np.bincount(cell, np.subtract(t, q, out=q))
            times = np.bincount(cell)
            if self.met:
                self.met[1][: len(times)] += times
            off /= times + s.map_inertia
            refined[: len(off)] += off
        chance *= np.float32(0.5)
        chance -= 1 - y
        np.abs(chance, out=chance)
        return np.clip(chance, 1e-5, 1 - 1e-5, out=chance)


class Tables:
    """What was counted, by predictor and range of the context; ranges are laid one after the other."""

    def __init__(self, range_bits: int, sizes: dict[tuple[int, int], int]):
        """``sizes``: the slots of each (predictor, range); ``fill`` brings what is in them."""
        self.shift = np.uint64(KEY - range_bits)
        size = np.ones((N, 1 << range_bits), np.int64)
        for (c, r), n in sizes.items():
            size[c, r] = n
        self.at = np.cumsum(size, axis=1) - size
        total = size.sum(axis=1)
        self.small = (33 - np.frexp(size[:2].astype(float))[1]).astype(np.uint32)  # 32 less the bits of a power of two
        self.odds = [np.zeros(total[c], np.int8) for c in range(2)]
        self.run_size = size[2].astype(np.uint64)
        self.symbol, self.run_odds, self.check = (np.zeros(total[2], k) for k in (np.int32, np.int8, np.uint8))

    def fill(self, c: int, r: int, *parts: np.ndarray) -> None:
        a = self.at[c, r]
        for into, x in zip([self.odds[c]] if c < 2 else [self.symbol, self.run_odds, self.check], parts):
            into[a : a + len(x)] = x

    def bit_table(self, c: int, ctx: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The stretched odds of every bit in a context of its symbol."""
        r = (ctx >> self.shift).astype(np.int64)
        x = np.repeat(ctx.astype(np.uint32), length)
        slot(x, code)
        small = self.small[c][r]
        if small.size and small.min() == small.max():
            x >>= small[0]
        else:
            np.right_shift(x, np.repeat(small, length), out=x)
        at = np.repeat(self.at[c][r], length)
        at += x
        return self.odds[c].take(at, mode="clip")

    def run(self, model: Model, ctx: np.ndarray, symbol: np.ndarray, length: np.ndarray, i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The stretched odds that the symbol which mostly followed the context gives to every bit, 0 where the code has left it."""
        r = (ctx >> self.shift).astype(np.int64)
        at = self.at[2][r] + place_of(ctx, self.run_size[r])
        hit = self.check.take(at, mode="clip") == check_of(ctx)
        guess = self.symbol.take(at, mode="clip")
        whole = lambda x: model.codes[x] << (np.uint32(32) - model.lengths[x])
        _, differ = np.frexp((whole(symbol) ^ whole(guess)).astype(float))
        same = np.where(hit, 32 - differ, -1).astype(np.int32)  # leading bits in which both codes agree
        odds = self.run_odds.take(at, mode="clip")
        same, odds = np.repeat(same, length), np.repeat(odds, length)
        sign = bit.view(np.int8) ^ (i == same)  # the bit that the guess has
        sign += sign
        sign -= np.int8(1)
        sign *= i <= same
        odds *= sign
        return odds


def slot(x: np.ndarray, code: np.ndarray) -> None:
    """Contexts (32 bits) to hashes with the code so far, of which the first bits are a slot."""
    x ^= code
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)


def place_of(ctx: np.ndarray, size: np.ndarray) -> np.ndarray:
    low = (ctx * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return ((low * size) >> np.uint64(32)).astype(np.int64)


def check_of(ctx: np.ndarray) -> np.ndarray:
    """From 1 to 255; 0 marks an empty slot."""
    return (np.uint64(1) + (ctx & np.uint64(0xFFFFFFFF)) % np.uint64(255)).astype(np.uint8)


def bit_part(model: Model, keys: np.ndarray, counts: np.ndarray, size_bits: int) -> np.ndarray:
    """The stretched odds of ``2 ** size_bits`` slots from distinct pairs."""
    found = np.zeros(2 << size_bits)
    for a in range(0, len(keys), 100_000):
        k, n = keys[a : a + 100_000], counts[a : a + 100_000]
        symbol = (k & np.uint64((1 << SYMBOL) - 1)).astype(np.int64)
        length = model.lengths[symbol].astype(np.int64)
        _, bit, code = model.bits(symbol, length)
        x = np.repeat((k >> np.uint64(SYMBOL)).astype(np.uint32), length)
        slot(x, code)
        x >>= np.uint32(32 - size_bits)
        np.add.at(found, x.astype(np.int64) * 2 + bit, np.repeat(n.astype(float), length))
    return stretched(found)


def run_part(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context the symbol that mostly followed it (the smallest on a tie) and the odds that it did; a slot keeps the context met most often."""
    ctx = keys >> np.uint64(SYMBOL)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    total = np.add.reduceat(counts, first).astype(np.int64)
    most = np.uint64((1 << SYMBOL) - 1)
    best = np.maximum.reduceat((counts.astype(np.uint64) << np.uint64(SYMBOL)) | (most - (keys & most)), first)
    n = (best >> np.uint64(SYMBOL)).astype(np.int64)
    odds = np.clip(np.rint(14 * np.log((n + 0.3) / (total - n + 0.3))), -126, 126).astype(np.int8)
    ctx, symbol = ctx[first], (most - (best & most)).astype(np.int32)
    at = place_of(ctx, np.uint64(size))
    out = np.zeros(size, np.int32), np.zeros(size, np.int8), np.zeros(size, np.uint8)
    # In order of how often the contexts were met, most of them once.
    more = np.flatnonzero(total > 1)
    by = np.concatenate([np.flatnonzero(total == 1), more[np.argsort(total[more], kind="stable")]])
    for into, x in zip(out, (symbol, odds, check_of(ctx))):
        into[at[by]] = x[by]
    return out


#: What part of ``table_bytes`` each predictor may take, and in how many ranges the first one's few contexts fall at most.
PARTS = (0.15, 0.25, 0.6)
ANCHOR_RANGES = 36


def part_of(model: Model, c: int, keys: np.ndarray, counts: np.ndarray, ranges: int = 1) -> list[np.ndarray]:
    """One of ``ranges`` parts of a predictor's table: of the size that its distinct pairs ask for, up to its share."""
    s = model.s
    share = PARTS[c] * s.table_bytes / (min(ranges, ANCHOR_RANGES) if c == 0 else ranges)
    if c < 2:
        wanted = max(int(s.slots * len(keys)) - 1, 1).bit_length()
        return [bit_part(model, keys, counts, max(8, min(wanted, int(share).bit_length() - 1)))]
    distinct = 1 + int(np.count_nonzero(np.diff(keys >> np.uint64(SYMBOL))))
    return list(run_part(keys, counts, max(1, min(int(s.run_slots * distinct), int(share / 6)))))


def tables_in_memory(model: Model, found: list[tuple[np.ndarray, np.ndarray]]) -> Tables:
    """Tables of one range from the distinct pairs of each predictor."""
    parts = [part_of(model, c, *x) for c, x in enumerate(found)]
    tables = Tables(0, {(c, 0): len(x[0]) for c, x in enumerate(parts)})
    for c, x in enumerate(parts):
        tables.fill(c, 0, *x)
    return tables


def fit_groups(model: Model, groups: Iterable[list[str]]) -> list[tuple[np.ndarray, ...]]:
    """Of each group weights, map, and how often each of their places was met: from the last quarter of its texts, read against the counts of the others.

    Groups learn each for itself, and are read side by side: a step of all at a time.
    """
    read = []
    for texts in groups:
        cut = len(texts) * 3 // 4
        if not cut:
            continue
        keys: list[list[np.ndarray]] = [[], [], []]
        for block in blocks(pa.array(texts[:cut], pa.string()), SMALL):
            for c, k in enumerate(model.pairs(block)):
                keys[c].append(k)
        model.tables = tables_in_memory(model, [counted(keys.pop(0)) for _ in range(N)])
        parts, sizes = [], []
        for block in blocks(pa.array(texts[cut:], pa.string()), SMALL):
            _, symbol, _, _, ctx = model.symbols(block)
            length = model.lengths[symbol].astype(np.int64)
            first_bit = np.append(np.concatenate([[0], np.cumsum(length)])[: len(symbol) : model.s.step], length.sum())
            sizes.append(np.diff(first_bit))
            for i, j in chunks(first_bit):
                part = slice(i * model.s.step, j * model.s.step)
                raw, bit = model.bit_inputs(symbol[part], ctx[:, part], length[part])
                bit += np.repeat(np.where(symbol[part] >= model.base, np.uint8(16), np.uint8(0)), length[part])
                parts.append((*raw, bit))
        model.tables = None
        read.append(([np.concatenate(x) for x in zip(*parts)], np.concatenate(sizes)))
    if not read:
        return []
    n, steps = len(read), max(len(size) for _, size in read)
    # Bits of each step and group, and where they start.
    size = np.zeros((steps, n), np.int64)
    for g, (_, x) in enumerate(read):
        size[: len(x), g] = x
    start = np.cumsum(size, axis=0) - size
    edges = np.concatenate([[0], np.cumsum(size.sum(axis=1))])
    mind = Mind(model, n, met=True)
    for i, j in chunks(edges):
        low, high = start[i], start[j - 1] + size[j - 1]
        # The bits of these steps, group after group, and then in the order of steps.
        held = [np.concatenate([x[c][a:b] for (x, _), a, b in zip(read, low, high)]) for c in range(N + 1)]
        begin = start[i:j] - low + (np.cumsum(high - low) - (high - low))
        lengths = size[i:j].ravel()
        order = np.arange(int(lengths.sum())) + np.repeat(begin.ravel() - (np.cumsum(lengths) - lengths), lengths)
        *raw, bit = (x.take(order) for x in held)
        key = np.repeat(np.tile(np.arange(n) * GATES, j - i), lengths) + (bit & np.uint8(16))
        mind.read(raw, bit & np.uint8(1), key, (edges[i : j + 1] - edges[i]).tolist())
    weights = mind.weights.reshape(n, GATES, N).transpose(0, 2, 1)
    return list(zip(weights, mind.refined.reshape(n, -1), mind.met[0].reshape(n, -1), mind.met[1].reshape(n, -1)))


def fit(model: Model, texts: list[str]) -> None:
    """``model`` with what one group teaches."""
    for weights, refined, *met in fit_groups(model, [texts]):
        model.weights, model.refined, model.met = weights, refined, tuple(met)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def training_counts(rows: DataFrame) -> DataFrame:
    """``kind, key, n`` over texts ``t``: 0 words by hash, 1 bytes of words, 2 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        by_byte, texts = np.zeros(256, np.int64), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate(keys), np.concatenate(counts)
            u, i = np.unique(k, return_inverse=True)
            return u, np.bincount(i, weights=c, minlength=len(u)).astype(np.int64)

        def batch(kind: int, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(_signed(k)), pa.array(c.astype(np.int64))], names=["kind", "key", "n"])

        for b in batches:
            for block in blocks(b.column(0)):
                w = Words(block, SPACED_LOWER)
                u, c = np.unique(w.hash, return_counts=True)
                keys.append(u)
                counts.append(c)
                held += len(u)
                by_byte += np.bincount(SPACED_LOWER[block.data], minlength=256)
                texts += block.n
                if held > 2_000_000:
                    u, c = merged()
                    keys, counts, held = [u], [c], len(u)
                    if held > 1_000_000:
                        for i in range(0, held, 200_000):
                            yield batch(0, u[i : i + 200_000], c[i : i + 200_000])
                        keys, counts, held = [], [], 0
        if keys:
            u, c = merged()
            for i in range(0, len(u), 200_000):
                yield batch(0, u[i : i + 200_000], c[i : i + 200_000])
        by_byte[0] = 0
        yield batch(1, np.arange(256, dtype=np.uint64), by_byte)
        yield batch(2, np.zeros(1, np.uint64), np.array([texts]))

    return rows.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Where:
    """What a worker needs to make the model: files in the shared folder and a few figures."""

    words: str
    rare: int
    texts: int
    byte_counts: tuple[int, ...]
    settings: Settings
    tables: tuple[str, str] | None = None  # of the first two predictors, of the third
    range_bits: int = 0
    weights: bytes | None = None
    refined: bytes | None = None


_made: dict[Where, Model] = {}


def _rows(path: str, columns: list[str]) -> Iterator[tuple]:
    """Rows of a folder of Parquet files, a few at a time; of a folder that isn't there, none."""
    fs, at = filesystem(path)
    for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 16).iter_batches(batch_size=8, columns=columns):
                    yield from zip(*(b.column(c).to_pylist() for c in columns))


def model_of(where: Where) -> Model:
    """The model, made once a worker and kept for its next tasks."""
    if where not in _made:
        _made.clear()
        fs, at = filesystem(where.words)
        t = pq.read_table(at, filesystem=fs, columns=["key", "n"])
        hashes, counts = (t.column(c).to_numpy() for c in ("key", "n"))
        model = Model(hashes.astype(np.int64).view(np.uint64), counts.astype(np.int64), where.rare, where.texts, np.array(where.byte_counts), where.settings)
        if where.weights:
            model.weights = np.frombuffer(where.weights, np.float32).reshape(N, GATES)
            model.refined = np.frombuffer(where.refined, np.float32)
        if where.tables:
            both, third = where.tables
            sizes = {(c, r): n for c, r, n in _rows(both, ["c", "r", "n"])} | {(2, r): n for r, n in _rows(third, ["r", "n"])}
            model.tables = Tables(where.range_bits, sizes)
            for c, r, x in _rows(both, ["c", "r", "x"]):
                model.tables.fill(c, r, np.frombuffer(zstandard.decompress(x), np.int8))
            for r, *raw in _rows(third, ["r", "x", "y", "z"]):
                model.tables.fill(2, r, *(np.frombuffer(zstandard.decompress(v), k) for v, k in zip(raw, (np.int32, np.int8, np.uint8))))
        _made[where] = model
    return _made[where]


def fitted(train: DataFrame, where: Where) -> Where:
    """``where`` with weights and map, fitted on all distinct training texts, in groups of about ``fit_bytes``."""
    s = where.settings
    if not s.fit_bytes:
        return where
    groups = max(1, -(-sum(where.byte_counts) // s.fit_bytes))
    # As many groups as are read together go to a task.
    group = F.pmod(F.hash(F.xxhash64("t")), F.lit(groups))
    dealt = train.select(group.alias("g"), "t").repartitionById(-(-groups // TOGETHER), F.floor(F.col("g") / TOGETHER).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, None]] = {}
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(g, {})[t] = None  # a copy goes at once
        model, order = model_of(where), sorted(held)
        for i in range(0, len(order), TOGETHER):
            texts = (sorted(held.pop(g), key=lambda t: (xxhash.xxh64_intdigest(t), t)) for g in order[i : i + TOGETHER])
            for weights, refined, *met in fit_groups(model, texts):
                n = np.concatenate([np.tile(met[0], N), met[1]])
                value = np.concatenate([np.ravel(weights), refined]).astype(np.float64)
                at = np.flatnonzero(n)
                # Whole numbers, whose sums are the same in any order.
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(np.rint(value * n * UNIT)[at].astype(np.int64))], names=["i", "n", "total"])

    # A row for each weight and each place of the map.
    rows = dealt.mapInArrow(run, "i int, n long, total long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    if not rows:  # too few texts to fit on
        return where
    weights = np.repeat(np.array(s.start, np.float64), GATES)
    grid = (np.arange(BUCKETS) + 0.5) * (16.0 / BUCKETS) - 8.0
    value = np.concatenate([weights, np.tile(1 / (1 + np.exp(-grid)), MAPS)])
    for r in rows:
        value[r["i"]] = r["total"] / UNIT / r["n"]
    weights, refined = np.clip(value[: N * GATES], 0.0, 1.5), value[N * GATES :]
    return Where(**{**where.__dict__, "weights": weights.astype(np.float32).tobytes(), "refined": refined.astype(np.float32).tobytes()})


def counted_pairs(train: DataFrame, where: Where, range_bits: int, most: int = 2_500_000) -> DataFrame:
    """``c, r, s, n, x``: distinct pairs of predictor ``c`` in range ``r``, with their counts; parts ``s`` by symbol.

    A task counts about ``most`` symbols at a time and sends the sorted runs on.
    """
    salts = (SALTS, SALTS, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(where)
        fresh: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for c in range(N):
                keys, counts = counted(fresh[c])
                fresh[c] = []
                for s in range(salts[c]):
                    mine = slice(None) if salts[c] == 1 else (keys & np.uint64(SALTS - 1)) == s
                    k, n = keys[mine], counts[mine]
                    r = (k >> np.uint64(64 - range_bits)).astype(np.int64)
                    cut = np.searchsorted(r, np.arange((1 << range_bits) + 1))
                    for i in np.flatnonzero(np.diff(cut)).tolist():
                        yield _row(c, i, s, k[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]])

        for b in batches:
            for block in blocks(b.column(0), SMALL):
                for c, k in enumerate(model.pairs(block)):
                    fresh[c].append(k)
                size += len(k)
                if size > most:
                    size = 0
                    yield from out()
        if size:
            yield from out()

    return train.mapInArrow(run, PAIRS)


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    each = [unpacked(x) for x in table.column("x").to_pylist()]
    return with_counts([k for k, _ in each], [n for _, n in each])


PAIRS = "c int, r int, s int, n long, x binary"


def _row(c: int, r: int, s: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([packed(keys, counts)], pa.binary())], names=["c", "r", "s", "n", "x"])


TABLES = "c int, r int, s int, n long, x binary, y binary, z binary"


def write_tables(train: DataFrame, where: Where, n_train: int) -> Where:
    """Count all pairs and write the tables; ``where`` with their paths.

    Runs are first merged by parts of a range, so that few and hot contexts are dealt over
    many tasks; the third predictor's, which has no such contexts, are made tables at once.
    """
    spark = train.sparkSession
    range_bits = min(16, max(4, (n_train >> 22).bit_length()))

    def tables_row(table: pa.Table) -> pa.Table:
        c, r = (table.column(k)[0].as_py() for k in ("c", "r"))
        got = part_of(model_of(where), c, *merged(table), 1 << range_bits)
        raw = [zstandard.compress(x.tobytes(), 1) for x in got] + [None] * (3 - len(got))
        return pa.table({"c": pa.array([c], pa.int32()), "r": pa.array([r], pa.int32()), "s": pa.array([0], pa.int32()), "n": pa.array([len(got[0])], pa.int64()), **{k: pa.array([x], pa.binary()) for k, x in zip("xyz", raw)}})

    def merge(table: pa.Table) -> pa.Table:
        c, r, p = (table.column(k)[0].as_py() for k in ("c", "r", "s"))
        if c == 2:
            return tables_row(table)
        row = pa.Table.from_batches([_row(c, r, p, *merged(table))])
        return row.append_column("y", pa.array([None], pa.binary())).append_column("z", pa.array([None], pa.binary()))

    third, both = new_path(spark, "lm-merged"), new_path(spark, "lm-tables")
    counted_pairs(train, where, range_bits).groupBy("c", "r", "s").applyInArrow(merge, TABLES).write.partitionBy("c").parquet(third)
    spark.read.schema(TABLES).parquet(third).where("c < 2").groupBy("c", "r").applyInArrow(tables_row, TABLES).write.parquet(both)
    return Where(**{**where.__dict__, "tables": (both, f"{third}/c=2"), "range_bits": range_bits})


def vocabulary(words: DataFrame, settings: Settings) -> tuple[str, int, int]:
    """Path of the words that occur ``settings.least`` times or more, their number and occurrences.

    If there are more than ``settings.words``, the least number is the first power of two
    that leaves no more.
    """
    size = words.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("k"))
    left, least = 0, settings.least
    for r in sorted(size.collect(), key=lambda r: -r["b"]):  # 64 rows at most
        left += r["k"]
        if left > settings.words:
            least = max(least, 2 << r["b"])
            break
    path = new_path(words.sparkSession, "lm-words")
    words.where(F.col("n") >= least).select("key", "n").write.parquet(path)
    kept = words.sparkSession.read.schema("key long, n long").parquet(path).agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    return path, kept["k"], kept["n"] or 0


def score_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Learns from the documents whose ``crc32`` of the id as text leaves another remainder than
    ``held_out`` (a null id: training).  Null texts count as empty and have one token, the
    end.  ``base_score``: sum over tokens of ``log10((c + 1) / (N + V + 1))``; ``score``: the
    model's log10 probability; ``bits_per_byte``: its bits over the text's bytes (null for
    none).  Equal rows get equal scores; other columns are not read.  Without any training
    text all words are unknown.
    """
    spark = df.sparkSession
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % modulus == held_out, F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    train = rows.where("not held_out").select("t")
    counted = materialise(training_counts(train), "word-counts")
    words = counted.where("kind = 0")
    totals = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    texts = (counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0)
    n_train, v_train = int(totals["n"] or 0) + texts, int(totals["v"]) + (texts > 0)
    by_byte = np.zeros(256, np.int64)
    for r in counted.where("kind = 1").collect():
        by_byte[r["key"]] = r["n"]
    path, _, within = vocabulary(words, settings)
    where = Where(path, n_train - texts - within, texts, tuple(by_byte.tolist()), settings)
    where = write_tables(train, fitted(train, where), n_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, done = model_of(where), TaskContext.get().partitionId() << 36
        gain = np.log10(m.counts.astype(float) + 1.0)
        for b in batches:
            for of, block in alike(b.column(2), SMALL):
                w, total = m.score(block)
                n = block.n
                known = np.bincount(w.doc[w.known], minlength=n)
                base = np.bincount(w.doc[w.known], weights=gain[w.at[w.known]], minlength=n) + np.log10(texts + 1.0)
                rare = ~w.known
                cut = np.concatenate([[0], np.cumsum(np.bincount(w.doc[rare], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(done + np.arange(n)),
                        b.column(0).take(of),
                        b.column(1).take(of),
                        pa.array(w.count + 1),
                        pa.array(known + (texts > 0)),
                        pa.array(base),
                        pa.array(total / np.log(10)),
                        pa.array(np.diff(block.offsets)),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(_signed(w.hash[rare]))),
                    ],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bytes", "rare"],
                )
                done += n

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialise(rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long, rare array<long>"), "scores")
    rare = scored.select("rid", F.explode("rare").alias("key")).join(words.select("key", "n"), "key")
    rare = rare.groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("k"))
    zero = float(np.log10(n_train + v_train + 1))
    out = scored.drop("rare").join(rare, "rid", "left")
    bits = F.when(F.col("bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("bytes"))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * zero).alias("base_score"),
        "score",
        bits.alias("bits_per_byte"),
    )
