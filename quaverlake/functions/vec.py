"""Vector arithmetic on array columns, inside the JVM and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest norm that a vector is divided by (the step of single precision at one).
EPS = 1.1920929e-7


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return _c(x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Null if either is null or the lengths differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def l2(a: Column | str) -> Column:
    """To length one; a zero vector stays zero."""
    # zipped with its repeated norm, which a lambda would take anew for every element
    v = doubles(a)
    return F.zip_with(v, F.array_repeat(F.greatest(norm(a), F.lit(EPS)), F.size(v)), lambda x, n: x / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for a zero vector."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def scale(a: Column | str, factor: Column | float) -> Column:
    return F.transform(doubles(a), lambda x: x * factor)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def usable(a: Column | str, dims: int) -> Column:
    """Of the right length, every element a finite number, and not all zero."""
    v = _c(a)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def rounded(a: Column | str, digits: int = 6) -> Column:
    return F.transform(doubles(a), lambda x: F.bround(x, digits))
