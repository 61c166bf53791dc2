"""Vector arithmetic on array columns, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    """0 for lengths that differ and for zero vectors."""
    n = norm(a) * norm(b)
    c = F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) if clamp else c


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def score(metric: str, a: Column, b: Column) -> Column:
    """Similarity from 0 to 1: higher is closer."""
    if metric == "cosine":
        return 1 - F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - cosine(a, b))) / 2
    if metric == "euclidean":
        return 1 / (1 + euclidean(a, b))
    if metric == "manhattan":
        return 1 / (1 + manhattan(a, b))
    if metric == "dot":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))
    raise ValueError(f"no metric {metric!r}")


def valid(v: Column) -> Column:
    """Neither empty nor with a value that isn't finite."""
    return (F.size(v) > 0) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def same_size(v: Column, n: int) -> Column:
    """``v`` if it has ``n`` values; an error otherwise."""
    return F.when(F.size(v) == n, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} values, found "), F.size(v).cast("string"))))


def size_issue(v: Column, n: int) -> Column:
    """What is wrong with the size of a vector, or null."""
    return F.when(F.size(v) != n, F.concat(F.lit(f"expected {n} values, found "), F.size(v).cast("string")))


def of_size(v: Column, n: int) -> Column:
    """``v`` if it has ``n`` values, null otherwise."""
    return F.when(F.size(v) == n, v)


def mock_embedding(text: Column, n: int = 384) -> Column:
    """A fixed unit vector for each text, for use without a model."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(2000001)) / 1000000.0 - 1.0)
    # One element, so that the norm is computed once and not for each value.
    once = F.transform(F.array(raw), lambda r: F.struct(r.alias("v"), norm(r).alias("n")))
    return F.get(F.transform(once, lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))


def toy_embedding(text: Column) -> Column:
    """Length, sum of code points and three constants."""
    points = F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.array(F.octet_length(text) / 100.0, points / 10000.0, F.lit(0.5), F.lit(-0.2), F.lit(0.8))
