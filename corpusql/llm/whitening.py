"""Embedding whitening from an exact integer scatter matrix.

An entry ``c`` counts as the integer ``floor(scale * c) + offset``.  Over the fit list, each
distinct vector once, every task subtracts a common shift and accumulates sums and
cross-products without rounding: entries are cut into limbs of 20 bits, whose products are
summed by a matrix product of doubles over so few rows that every value stays an integer
below 2 ** 53, and the limbs' sums are put together as integers of any size.  Tasks hand on
the upper triangle in digits of base 2 ** 32, which Spark adds up; the shift falls out of
``n * X'X - S S'``.  Only that exact matrix is divided by ``n ** 2`` (one correctly rounded
division an entry) and decomposed.

What meets on the driver is the triangle, whose size is set by the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusql.llm.common import materialise

LIMB = 20  # bits of a limb: 2 * LIMB + 12 stays within the 53 of a double
ROWS = 1 << 12  # rows of one product of doubles
DIGITS = 7  # of base 2 ** 32: entries of 64 bits, squared, over 2 ** 64 rows
CELLS = 1 << 20  # of vectors that are worked on at once
FLAT = 1e-12  # a component with less than this share of the largest eigenvalue has no variance


def integers(v: Column, scale: int, offset: int) -> Column:
    """``floor(scale * c) + offset`` of each entry; beyond 2 ** 62 on either side an entry counts as that bound."""
    most = float(2**62)
    return F.transform(v, lambda c: F.floor(F.greatest(F.least(scale * c.cast("double"), F.lit(most)), F.lit(-most))) + F.lit(offset).cast("long"))


def usable(v: Column) -> Column:
    """Neither null itself nor with an entry that is null or not finite."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of equally long vectors: places in the column, and their entries."""
    sizes = np.asarray(column.value_lengths())
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        for i in range(0, len(at), max(1, CELLS // d)):
            some = at[i : i + max(1, CELLS // d)]
            yield some, np.asarray(column.take(pa.array(some)).flatten()).reshape(len(some), d)


class Scatter:
    """Exact ``n``, sums and cross-products of the rows seen."""

    def __init__(self, d: int):
        self.d, self.n, self.waiting = d, 0, 0
        self.sums = np.zeros(d, object)
        self.cross = np.zeros((d, d), object)
        self.part: dict[int, np.ndarray] = {}  # by the limbs' order, in 64 bits

    def see(self, y: np.ndarray) -> None:
        for i in range(0, len(y), ROWS):
            z = y[i : i + ROWS]
            limbs, rest = [], z
            while len(limbs) == 0 or np.any(rest):  # the last limb keeps the sign
                low = rest & ((1 << LIMB) - 1) if rest.max(initial=0) >= 1 << LIMB or rest.min(initial=0) < -(1 << LIMB) else rest
                limbs.append(low)
                rest = (rest - low) >> LIMB
            self.n += len(z)
            for j, x in enumerate(limbs):
                self.sums += x.sum(0).astype(object) << (LIMB * j)
            floats = [x.astype(np.float64) for x in limbs]
            for a, x in enumerate(floats):
                for b, w in enumerate(floats):
                    at = self.part.setdefault(a + b, np.zeros((self.d, self.d), np.int64))
                    at += (x.T @ w).astype(np.int64)
            self.waiting += 1
            if self.waiting == 128:  # each product is below 2 ** 52, of at most five of one order
                self.settle()

    def settle(self) -> None:
        for order, m in self.part.items():
            self.cross += m.astype(object) << (LIMB * order)
        self.part, self.waiting = {}, 0

    def rows(self) -> pa.RecordBatch:
        """``d, i, j`` and the digits: the triangle, the sums (j = -1) and the number of rows (i = j = -1)."""
        self.settle()
        i, j = np.triu_indices(self.d)
        values = np.concatenate([self.cross[i, j], self.sums, np.array([self.n], object)])
        i = np.concatenate([i, np.arange(self.d), [-1]])
        j = np.concatenate([j, np.full(self.d + 1, -1)])
        digits = []
        for k in range(DIGITS):
            digits.append(pa.array((values if k == DIGITS - 1 else values & 0xFFFFFFFF).astype(np.int64)))
            values = values >> 32
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), self.d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *digits], names=["d", "i", "j", *[f"g{k}" for k in range(DIGITS)]])


def scatter(fit: DataFrame, shift: int) -> DataFrame:
    """``fit`` (x) to the added triangle of each dimension, ``d, i, j`` and digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Scatter] = {}
        for batch in batches:
            for _, x in _rows(batch.column(0)):
                seen.setdefault(x.shape[1], Scatter(x.shape[1])).see(x - shift)
        for s in seen.values():
            yield s.rows()

    digits = [f"g{k}" for k in range(DIGITS)]
    parts = fit.mapInArrow(run, "d int, i int, j int, " + ", ".join(f"{g} long" for g in digits))
    return parts.groupBy("d", "i", "j").agg(*[F.sum(g).alias(g) for g in digits])


class Model:
    """What whitens the vectors of one dimension: exact ``n`` and sums, and the leading components."""

    def __init__(self, d: int, table: pa.Table, shift: int, most: int):
        i, j = (np.asarray(table.column(c)) for c in ("i", "j"))
        values = np.zeros(len(i), object)
        for k in reversed(range(DIGITS)):
            values = (values << 32) + np.asarray(table.column(f"g{k}")).astype(object)
        self.d, self.shift, self.n = d, shift, int(values[(i == -1) & (j == -1)][0])
        sums = np.zeros(d, object)
        at = (i >= 0) & (j == -1)
        sums[i[at]] = values[at]
        self.sums = sums  # of the shifted entries
        cross = np.zeros((d, d), object)
        at = j >= 0
        cross[i[at], j[at]] = cross[j[at], i[at]] = values[at]
        exact = self.n * cross - np.outer(sums, sums)
        # Python divides integers with one correct rounding, however large they are.
        v = (exact / (self.n * self.n)).astype(np.float64)
        e, w = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")[: min(most, d)]
        self.e, self.w = e[order], w[:, order]
        self.real = self.e > FLAT * max(float(e.max()), 0.0)
        trace = float(sum(exact.diagonal().tolist(), 0) / (self.n * self.n))
        self.explained = np.where(self.real, self.e, 0.0) / trace if trace else np.full(len(order), np.nan)
        self.scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, self.e, 1.0)), np.nan)
        self.error = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: in 64 bits if that holds it, else as integers of any size."""
        y = x - self.shift
        bound = self.n * int(max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))) + max([0, *(abs(s) for s in self.sums.tolist())])
        if bound < 1 << 62:
            return self.n * y - self.sums.astype(np.int64)
        return self.n * y.astype(object) - self.sums

    def whitened(self, t: np.ndarray) -> np.ndarray:
        return ((t / self.n).astype(np.float64) @ self.w) * self.scale

    @staticmethod
    def deviation(t: np.ndarray) -> np.ndarray:
        """Sums of squares, exact."""
        if t.dtype != object:
            most = int(max(abs(int(t.max(initial=0))), abs(int(t.min(initial=0)))))
            if most * most * t.shape[1] < 1 << 62:
                return (t * t).sum(1).astype(object)
            if most < 1 << 50 and t.shape[1] < 1 << 20:
                a, b = t >> 25, t & ((1 << 25) - 1)
                if (most >> 25) ** 2 * t.shape[1] < 1 << 60:
                    return ((a * a).sum(1).astype(object) << 50) + ((a * b).sum(1).astype(object) << 26) + (b * b).sum(1).astype(object)
            t = t.astype(object)
        return (t * t).sum(1)


def models(fit: DataFrame, shift: int, most: int) -> dict[int, Model]:
    """The model of each dimension that occurs, with how far its whitened fit list is from unit covariance."""
    added = materialise(scatter(fit, shift), "scatter")
    found = {d: Model(d, added.where(F.col("d") == d).toArrow(), shift, most) for d in sorted(r.d for r in added.select("d").distinct().collect())}
    shared = fit.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _rows(batch.column(0)):
                m = shared.value[x.shape[1]]
                z = m.whitened(m.centred(x))[:, m.real]
                z = np.hstack([np.ones((len(z), 1)), z])
                sums[m.d] = sums.get(m.d, 0) + z.T @ z
        for d, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(s.ravel())], names=["d", "i", "j", "s"])

    again = fit.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s"))
    for d, rows in again.toPandas().groupby("d"):
        s = rows.pivot(index="i", columns="j", values="s").to_numpy() / found[d].n
        mean, covariance = s[0, 1:], s[1:, 1:]
        if len(mean):
            found[d].error = float(np.abs(covariance - np.outer(mean, mean) - np.eye(len(mean))).max())
    return found


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 16) -> DataFrame:
    """A row for each usable vector and leading component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, or that hold a null or non-finite entry, are left out; an empty
    vector has no components.  The rest are fitted on each distinct integer vector once.
    ``deviation`` is a decimal of 38 digits (null beyond them).  Vectors of different lengths
    are different spaces, each fitted by itself.  A component without variance (equal
    vectors, fewer vectors than dimensions) has ``whitened`` null and ``explained`` 0 (null
    where nothing varies at all), and does not count in ``identity_error``, which is null if
    none is left.  Null and repeated ids keep their rows.  Other columns are not read.
    """
    v = F.col(f"`{vector_col}`")
    rows = df.where(usable(v)).select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(v, scale, offset).alias("x"))
    fit = materialise(rows.select("x").where(F.size("x") > 0).distinct(), "whitening-fit")
    shared = df.sparkSession.sparkContext.broadcast(models(fit, offset, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _rows(batch.column(1)):
                m = shared.value[x.shape[1]]
                t, k = m.centred(x), len(m.e)
                own = np.repeat(at, k)
                each = lambda a: pa.array(np.tile(a, len(at)), from_pandas=True)
                deviation = pa.array([s if s < 10**38 else None for s in m.deviation(t).tolist()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(own), m.n)), deviation.take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(m.whitened(t).ravel(), from_pandas=True), each(m.explained), pa.array([m.error] * len(own), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
