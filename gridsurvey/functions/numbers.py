"""Numeric column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double: x/0 is infinite (so it passes a ``>=`` test), 0/0 is null."""
    n, d = n.cast("double"), d.cast("double")
    return F.when(d != 0, n / d).when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))


def row_sum(*cols: Column) -> Column:
    """Sum across columns of one row with null taken as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def all_true(*cols: Column) -> Column:
    """Three-valued conjunction across columns of one row."""
    return reduce(lambda a, b: a & b, cols)


def log_breaks(lo: Column, hi: Column, length) -> Column:
    """``length`` numbers from lo to hi, evenly spaced in the logarithm, rounded half to even.

    ``length`` is a number or a Column. Bounds must be positive.
    """
    length = length if isinstance(length, Column) else F.lit(length)
    steps = F.greatest(length - 1, F.lit(1)).cast("double")
    points = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.bround(F.exp(F.ln(lo.cast("double")) + i * (F.ln(hi.cast("double")) - F.ln(lo.cast("double"))) / steps)),
    )
    bad = (lo <= 0) | (hi <= 0)
    return F.when(bad, F.raise_error(F.lit("lo and hi must be > 0"))).otherwise(points)


def class_of(value: Column, breaks: Column) -> Column:
    """How many of the ascending breaks are at or below the value (0 = below the first)."""
    return F.size(F.filter(breaks, lambda b: b <= value))


def uniform_key(seed: int, *cols: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1) from a seed and the row's key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def mercator_x(lon: Column) -> Column:
    return F.lit(6378137.0) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(6378137.0) * F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))
