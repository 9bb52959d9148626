"""Vector algebra on array<float|double> columns; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COMPOSITIONS = ("concat", "hadamard", "abs_diff", "average")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either side has no direction."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(v: Column, strict: bool = False) -> Column:
    """The vector over its norm; a zero row stays zero, or is an error if ``strict``."""
    n = norm(v)
    zero = F.raise_error(F.lit("a vector of zero norm has no direction")).cast("array<double>") if strict else doubles(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(zero)


def compose(a: Column, b: Column, how: str) -> Column:
    """concat, hadamard, abs_diff or average of two vectors."""
    if how == "concat":
        return F.concat(doubles(a), doubles(b))
    f = {"hadamard": lambda x, y: x * y, "abs_diff": lambda x, y: F.abs(x - y), "average": lambda x, y: (x + y) / 2}.get(how)
    if f is None:
        raise ValueError(f"composition must be one of {COMPOSITIONS}, not {how!r}")
    return F.zip_with(doubles(a), doubles(b), f)


def prefix(v: Column, n: int) -> Column:
    return F.slice(v, 1, n)


def valid(v: Column, dim: int | Column) -> Column:
    """Whether a vector has the length and only finite values."""
    d = F.lit(dim) if isinstance(dim, int) else dim
    return F.coalesce((F.size(v) == d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def mean_pool(rows: Column) -> Column:
    """Mean of an array of equally long vectors, position by position."""
    total = F.aggregate(rows, F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0)), lambda s, r: F.zip_with(s, doubles(r), lambda x, y: x + y))
    return F.when(F.size(rows) > 0, F.transform(total, lambda x: x / F.size(rows)))
