"""Words, hashes, token ids and quality figures against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corpusql.llm.encoder import Encoder
from corpusql.llm.packing import Tournament, first_fit_decreasing, pack_group
from corpusql.llm.quality import FIELDS, Rules, measure
from corpusql.llm.queries import vocabulary
from corpusql.llm.token_files import Reader, pack
from corpusql.llm.vectext import ALNUM_LOWER, SPACED, SPACED_LOWER, blocks

LETTERS = "ab AB.,\n\t#é漢0-\x0b \x00"
texts = st.lists(st.text(LETTERS, max_size=60), max_size=8)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words(ts):
    for table, pattern, low in ((SPACED, r"[^\x20\x09-\x0D]+", False), (SPACED_LOWER, r"[^\x20\x09-\x0D]+", True), (ALNUM_LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        seen = {}
        for b in blocks(pa.array(ts, pa.string()), 40):
            w = b.words(table)
            got = [[] for _ in range(b.n)]
            for s, e, d, h in zip(w.start, w.end, w.doc, w.hash):
                word = b.data[s:e].tobytes().decode()
                word = lower(word) if low else word
                assert seen.setdefault(int(h), word) == word
                got[d].append(word)
            for i in range(b.n):
                assert got[i] == re.findall(pattern, lower(ts[b.first + i]) if low else ts[b.first + i])
        assert len(set(seen.values())) == len(seen)


def brute_quality(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_quality_figures(ts):
    parts = [measure(b, Rules()) for b in blocks(pa.array(ts, pa.string()), 50)]
    got = [tuple(x) for p in parts for x in zip(*[p[k].tolist() for k in FIELDS])]
    assert got == [brute_quality(t) for t in ts]


def brute_verdict(t, rules=Rules()):
    """The shares and the verdict, by counting in plain Python."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    ws = [t[a:b] for a, b in spans]
    n, total = len(ws), max(1, sum(map(len, ws)))
    out = {}
    for k in (*rules.top, *rules.duplicate):
        at = {}
        for i in range(n - k + 1):
            at.setdefault(tuple(ws[i : i + k]), []).append(i)
        chars = lambda places: sum(len(ws[j]) for j in {i + d for i in places for d in range(k)})
        again = [p for p in at.values() if len(p) > 1]
        if k in rules.top:
            best = max(again, key=lambda p: (len(p) * sum(map(len, ws[p[0] : p[0] + k])), -p[0]), default=[])
            out[f"top_{k}_share"] = chars(best) / total
        else:
            out[f"dup_{k}_share"] = chars([i for p in again for i in p]) / total
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = set(), []
    for x in lines:
        again += [x] * (x in seen)
        seen.add(x)
    out["dup_line_share"] = len(again) / max(1, len(lines))
    out["dup_line_char_share"] = sum(len(w) for x in again for w in re.findall(r"[^\x20\x09-\x0D]+", x)) / total
    more = min(rules.allowance, 2 * rules.sentence / max(n, 1))
    limits = {f"top_{k}_share": x for k, x in rules.top.items()} | {f"dup_{k}_share": x for k, x in rules.duplicate.items()} | {"dup_line_share": rules.max_dup_lines, "dup_line_char_share": rules.max_dup_line_chars}
    _, _, symbols, _, repeat = brute_quality(t)
    failed = n < rules.min_words or 100 * repeat > 50 * n
    return out, not (failed or any(out[k] > x + more for k, x in limits.items()) or symbols > rules.max_symbols * n)


def test_quality_shares():
    rng = random.Random(3)
    ts = []
    for _ in range(60):
        words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([8, 40, 400]))]
        ts.append("".join(rng.choice(words) + rng.choice("   \n") for _ in range(rng.randint(0, 400))))
        ts.append(ts[-1] + "\n" + ts[-1][: rng.randint(0, 80)])
    (p,) = [measure(b, Rules()) for b in blocks(pa.array(ts))]
    for i, t in enumerate(ts):
        shares, kept = brute_verdict(t)
        assert {k: p[k][i] for k in shares} == pytest.approx(shares) and p["kept"][i] == kept


def test_quality_verdicts():
    rng = random.Random(1)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200))
    bad = ["short text", clean + ("\n" + clean) * 3, "one two three " * 60, " ".join(w + "%%" for w in clean.split()), ""]
    (p,) = [measure(b, Rules()) for b in blocks(pa.array([clean, *bad]))]
    assert p["kept"].tolist() == [True] + [False] * 5


ODD = ["", "a", "A.b. c.. d", "x, y,, z”. q", " a b", "hi <|endoftext|> x", "<|ENDOFTEXT|>", "É. é, ÷. ×,", "İx ΣΑΣ. don't DON'T we'll", "one\x1ctwo", "1.5 2, 3.", "ß. œ, ſ.", "..., ,. .", "日本。 日, ー.", "é É."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_token_ids(ts):
    e = encoder()
    for t, x in zip(ts + ODD, e.encode(ts + ODD)):
        assert x.tolist() == e.whole.encode(t, add_special_tokens=False).ids + [1]


_one = []


def encoder():
    if not _one:
        _one.append(Encoder(vocabulary(), 1))
    return _one[0]


def test_encoder_that_forgets():
    small = Encoder(vocabulary(), 1, remembered=3)
    ts = ["one two three four five.", "six seven, eight", "one nine", None] * 3
    for a, b in zip(small.encode(ts), encoder().encode(ts)):
        assert a.tolist() == b.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=40))
def test_token_file(lengths):
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 49408, n).astype(np.uint32) for n in lengths]
    ids = [None if i % 7 == 3 else i for i in range(len(lengths))]
    for width in (2, 4):
        import io

        raw = pack(ids, tokens, id_bytes=width, frame_bytes=600)
        r = Reader(io.BytesIO(raw), len(raw))
        assert [None if n else d for d, n in zip(r.doc_ids.tolist(), r.nulls)] == ids and r.counts.tolist() == lengths
        for i in reversed(range(len(lengths))):
            assert r.tokens(i).tolist() == tokens[i].tolist()
        if sum(lengths):
            broken = bytearray(raw)
            broken[int(r.frames[0, 0]) - 1] ^= 255
            with pytest.raises(Exception):
                Reader(io.BytesIO(bytes(broken)), len(raw)).frame(0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40))
def test_packing(lengths):
    whole = pack_group(lengths, 20)
    cuts = sum(len(x) for x in whole) - sum(-(-n // 20) for n in lengths)
    assert cuts == 0 and all(sum(p[2] for p in s) <= 20 for s in whole)
    seqs = pack_group(lengths, 20, refill=True)
    seen = {d: [] for d in range(len(lengths))}
    for s in seqs:
        assert 0 < sum(p[2] for p in s) <= 20
        for d, a, n in s:
            assert n > 0
            seen[d].append((a, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(seen[d]):
            assert a == at
            at += k
        assert at == n
    waste = [20 - sum(p[2] for p in s) for s in seqs if bin(sum(p[2] for p in s)).count("1") != 1]
    assert sum(w > 0 for w in waste) <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=30))
def test_first_fit(lengths):
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[j] for j in b) + lengths[i] <= 10:
                b.append(i)
                break
        else:
            bins.append([i])
    assert first_fit_decreasing(lengths, 10) == bins
    t = Tournament(3, 5)
    t.take(0, 4)
    assert t.first(2) == 1 and t.first(1) == 0 and t.first(6) == -1


def test_crc_of_ids():
    x = encoder().encode(["Hello there."])[0]
    assert zlib.crc32(x.astype("<u4").tobytes()) == zlib.crc32(np.array(encoder().whole.encode("Hello there.", add_special_tokens=False).ids + [1], "<u4").tobytes())
