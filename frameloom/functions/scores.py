"""Column expressions over retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .frames import squeeze

#: The readable tiers.
TIERS = ("hot", "warm", "cold")
_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_NARROW = "".join(chr(0x61 + i) for i in range(26)) * 2


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Score within [lo, hi]; null, NaN and infinities are 0."""
    odd = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def max_normalise(c: Column, *by: str) -> Column:
    """Score divided by the largest of its list; all 0 if that isn't positive."""
    top = F.max(c).over(Window.partitionBy(*by))
    return F.when(top > 0, c / top).otherwise(0.0)


def tier_of(c: Column, hot: float = 0.20, warm: float = 0.12) -> Column:
    """hot, warm or cold by score; a null or NaN score has no tier."""
    return F.when(c.isNull() | F.isnan(c), None).when(c >= hot, "hot").when(c >= warm, "warm").otherwise("cold")


def read_tier(c: Column) -> Column:
    """hot, warm or cold from its many spellings (case, blanks, full-width letters, decoration).

    Null if none of the three words stands in the text, or more than one.
    """
    plain = squeeze(c)
    s = F.translate(plain, _WIDE, _NARROW)
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(rf"(?<![a-z])({'|'.join(TIERS)})(?![a-z])"), 1))
    # Most are plainly spelt and need no pattern.
    return F.when(plain.isin(*TIERS), plain).when(F.size(found) == 1, F.get(found, F.lit(0)))


def badge(c: Column, good: float = 0.7, fair: float = 0.4) -> Column:
    """Traffic light of a score; a null one is red."""
    return F.when(c >= good, "green").when(c >= fair, "yellow").otherwise("red")


def band(c: Column, edges: tuple[float, ...] = (0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 1.01)) -> Column:
    """Number (from 0) of the half-open band [edge, next edge) of a score; null outside all."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((c >= edges[i]) & (c < edges[i + 1]), i).otherwise(out)
    return out
