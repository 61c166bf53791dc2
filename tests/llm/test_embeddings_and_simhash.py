"""Whitening against integers in plain Python, and SimHash against all pairs."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from corpusql.llm import queries as Q
from corpusql.llm import simhash as S
from corpusql.llm import whitening as W

# 11


def whitened(rows):
    """By the definition, one vector at a time: {row: (n, deviation, [(values up to sign, explained)])}."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in sorted({len(x) for _, x in kept} - {0}):
        fit = sorted({tuple(x) for _, x in kept if len(x) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        exact = [[n * sum(x[i] * x[j] for x in fit) - s[i] * s[j] for j in range(d)] for i in range(d)]
        v = np.array([[m / n**2 for m in r] for r in exact])
        e, w = np.linalg.eigh(v)
        e, w = e[::-1], w[:, ::-1]
        for i, x in kept:
            if len(x) == d:
                t = [n * a - b for a, b in zip(x, s)]
                for c in range(min(16, d)):
                    flat = e[c] <= 1e-12 * max(e[0], 0)
                    out.append((i, c + 1, n, sum(a * a for a in t), None if flat else float(np.array([a / n for a in t]) @ w[:, c]) / math.sqrt(e[c]), (0.0 if flat else e[c] / np.trace(v)) if np.trace(v) else None))
    return out


def compare(got, rows):
    want = sorted(whitened(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4] or 0)))
    got = sorted(got, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component, r.deviation, abs(r.whitened or 0)))
    assert [(r.vec_id, r.component, r.n, int(r.deviation)) for r in got] == [w[:4] for w in want]
    signs = {}
    for g, w in zip(got, want):
        assert (g.explained is None) == (w[5] is None) and (g.whitened is None) == (w[4] is None)
        assert w[5] is None or g.explained == pytest.approx(w[5], rel=1e-9)
        if w[4] is not None and abs(w[4]) > 1e-6:
            sign = signs.setdefault((g.n, g.component), math.copysign(1, g.whitened * w[4]))
            assert g.whitened * sign == pytest.approx(w[4], abs=1e-8)
        assert g.identity_error is None or g.identity_error < 1e-6


def test_whitening_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = Q.QUERIES["op11_whitening"](spark, DATA).collect()
    assert len(got) == 16 * len(rows) and len({r.identity_error for r in got}) == 1
    compare(got, rows)


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(50, 60)]  # fewer vectors than dimensions
    rows += [(70, None), (71, [1.0, None, 2.0]), (72, [nan, 0.0, 0.0]), (73, [inf, 0.0, 0.0]), (74, [-inf, 1.0, 1.0]), (75, []), (None, [0.5, 0.25, 0.125])]
    rows += [(80, [7.0]), (81, [7.0]), (81, [7.0])]  # nothing varies
    rows += [rows[0]] * 30 + [(90, rows[1][1])]  # repeated rows count once in the fit list
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, component string, n double")
    out = W.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(out.collect(), rows)
    flat = out.where("vec_id in (80, 81)").collect()
    assert len(flat) == 3 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 for r in flat)
    assert W.whiten(df.limit(0)).collect() == []
    assert W.whiten(df.where("vec_id = 70")).collect() == []


def test_whitening_large_entries(spark):
    """Sums beyond 64 and 128 bits stay exact; an entry out of range counts as the bound."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0**e for e in (0, 30, 52)]) for i in range(60)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    exact = {(r[0], r[1]): r[3] for r in whitened(rows)}
    assert max(exact.values()) > 2**128 or max(exact.values()) > 10**38
    assert all((int(r.deviation) if r.deviation is not None else None) == (x if (x := exact[r.vec_id, r.component]) < 10**38 else None) for r in got)
    huge = W.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>"))
    assert huge.count() == 6
    assert {r.deviation for r in Q.QUERIES["op11_whitening"](spark, DATA).limit(3).collect()} and dict(Q.QUERIES["op11_whitening"](spark, DATA).dtypes)["deviation"] == "bigint"


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for most in (50, 1 << 19, (1 << 20) + 3, 1 << 45, 1 << 62):
        y = rng.integers(-most, most, (9000, 3))
        s = W.Scatter(3)
        s.see(y[:5000])
        s.see(y[5000:])
        s.settle()
        big = y.astype(object)
        assert (s.cross == big.T @ big).all() and (s.sums == big.sum(0)).all() and s.n == 9000
        table = s.rows()
        at = [i for i in range(table.num_rows) if (table.column(1)[i].as_py(), table.column(2)[i].as_py()) == (0, 1)][0]
        assert sum(table.column(3 + k)[at].as_py() << (32 * k) for k in range(W.DIGITS)) == (big.T @ big)[0, 1]


# 12

SPACED = r"[^\x20\x09-\x0D]+"


def print_of(text):
    w = re.findall(SPACED, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """{id: smallest id reachable} over all pairs of (id, fingerprint)."""
    up = {i: i for i, _ in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, x) in enumerate(prints):
        for j, y in prints[:n]:
            if (x ^ y).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}


def test_fingerprint_is_sparks_hash(spark):
    """The shingle hash is the one that Spark's own function gives."""
    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b é".encode(), seed=42)


def test_simhash_table(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = sorted((i, print_of(t)) for i, t in text.items())
    want = grouped(prints)
    got = {r.doc_id: r for r in Q.QUERIES["op12_simhash"](spark, DATA).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == dict(prints)
    assert {i: r.component_id for i, r in got.items()} == want and len(set(want.values())) < len(want)
    assert all(len(r.fingerprint) == 16 for r in got.values())


def test_simhash_odd(spark):
    long = " ".join(f"Wörd{i % 977}" for i in range(70_000))
    rows = [(3, "a b c\nd e f"), (3, "a b c\nd e f"), (9, "A\x0bB  c d\te\x0cf "), (4, None), (7, ""), (5, " \n"), (None, "a b c d e f"), (8, long), (6, long.upper().replace("Ö", "ö") + " end"), (8, "one"), (2, "ONE"), (1, "x\x00y \x1cz"), (10, "x\x00y \x1cz " * 2)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, fingerprint string, fp long")
    out = S.simhash_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in out) == sorted((str(i), f"{print_of(t):016x}") for i, t in rows)
    # 8 has two texts and so joins those of either.
    c = {r.doc_id: r.component_id for r in out}
    assert c == {3: 3, 9: 3, 4: 4, 7: 4, 5: 4, None: None, 8: 2, 6: 2, 2: 2, 1: 1, 10: c[10]}
    assert S.simhash_duplicates(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.simhash_duplicates(df, radius=4)


def test_masks_cover():
    """Whatever bits differ, up to the radius, some mask of every round avoids them all; masks are even and large."""
    rng = random.Random(1)
    own = S.covering(list(range(64)), 3)
    assert len(own) == 15 and all(32 <= m.bit_count() <= 36 for m in own)
    every = [sum(1 << b for b in (i, j, k)) for i in range(64) for j in range(i + 1) for k in range(j + 1)]
    assert all(any(not m & d for m in own) for d in every)
    levels = S.masks(3)
    for d in rng.sample(every, 300):
        parents = {0}
        for level in levels:
            parents = {t for p, t, m in level if p in parents and not m & d}
            assert parents
    assert all(64 - m.bit_count() <= 8 for _, _, m in levels[-1])


def test_crowds(spark):
    """A crowd of fingerprints in few free bits, with buckets so small that all rounds are used."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    places = rng.sample(range(64), 16)
    prints = {centre ^ sum(1 << p for p in places if rng.random() < 0.5) for _ in range(900)}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    prints |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in list(prints)[:150]}
    prints = list(enumerate(sorted(prints)))
    classes = spark.createDataFrame([(x - (x >> 63 << 64), i) for i, x in prints], "fp long, id long")
    for radius in (1, 2, 3):
        up = {i: i for i, _ in prints}
        for bucket in (3, 4096):
            found = S.links(spark, classes, radius, bucket, 1 << 20).collect()
            of = dict(prints)
            assert all((of[r.a] ^ of[r.b]).bit_count() <= radius for r in found)

            def root(i, up):
                while up[i] != i:
                    i = up[i]
                return i

            up = {i: i for i, _ in prints}
            for r in found:
                a, b = sorted((root(r.a, up), root(r.b, up)))
                up[b] = a
            got = {i: root(i, up) for i in up}
            want = grouped(prints) if radius == 3 else None
            if want:
                assert got == want
            else:
                whole = {i: i for i, _ in prints}
                for n, (i, x) in enumerate(prints):
                    for j, y in prints[:n]:
                        if (x ^ y).bit_count() <= radius:
                            a, b = sorted((root(i, whole), root(j, whole)))
                            whole[b] = a
                assert got == {i: root(i, whole) for i in whole}
