"""Interval and rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Round the scaled double half to even: binary value first, no decimal re-reading.

    Agrees with rounding the exact binary value except where scaling itself hits a tie.
    """
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): score interval of a proportion, (0, 0) when nothing was counted."""
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = (z / denom) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(low.alias("low"), high.alias("high"))


def share(part: Column, whole: Column, digits: int) -> Column:
    """Rounded part / whole; null, never 0, when the whole is 0 or missing."""
    return F.when(whole != 0, rounded(part / whole, digits))


def median_of(values: Column) -> Column:
    """Exact median of an array: middle element or mean of the two middle ones."""
    s = F.array_sort(values)
    n = F.size(s)
    mid = F.floor(n / 2).cast("int")
    at = lambda i: F.get(s, i).cast("double")
    return F.when(n > 0, F.when(n % 2 == 1, at(mid)).otherwise((at(mid - 1) + at(mid)) / 2))
