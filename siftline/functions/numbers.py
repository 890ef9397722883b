"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, decimals: int = 2) -> Column:
    """A number with so many decimals, rounded from its exact binary value, ties to
    even, as C and Python print it. (``format_string`` rounds the shortest decimal form instead:
    0.365, which is a little less than that, becomes 0.37.)

    The product with 10 ** decimals is taken with its rounding error (Dekker), so a half is told
    from what only looks like one."""
    sign, x = F.when(x < 0, "-").otherwise(""), F.abs(x)
    scale = float(10**decimals)
    p = x * F.lit(scale)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    error = (high * F.lit(scale) - p) + (x - high) * F.lit(scale)
    low = F.floor(p)
    part = p - low
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    k = low + F.when(up, 1).otherwise(0)
    whole = F.floor(k / F.lit(10**decimals)).cast("bigint")
    return F.format_string(f"%s%d.%0{decimals}d", sign, whole, k - whole * F.lit(10**decimals))
