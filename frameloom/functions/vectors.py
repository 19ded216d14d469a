"""Column expressions over vectors (array<float> or array<double>); arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; an all-zero vector stays as it is."""
    # The norm is an argument, not part of the lambda, so it is computed once for a vector and not for each value.
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def is_usable(a: Column) -> Column:
    """True for a vector that is not null, not empty, finite throughout and not all zero."""
    odd = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) > 0) & ~odd & F.exists(a, lambda x: x != 0), F.lit(False))


def is_unit(a: Column, tolerance: float = 1e-4) -> Column:
    """True if the norm is 1 within the tolerance, or 0."""
    n = norm(a)
    return (F.abs(n - 1) < tolerance) | (n == 0)


def sign_hash(a: Column) -> Column:
    """64-bit hash of the signs of the first 64 values (a bit is set where a value is at least 0); null for a null vector."""
    bits = F.transform(F.slice(a, 1, 64), lambda x: F.when(x >= 0, 1).otherwise(0))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("bigint")))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))
