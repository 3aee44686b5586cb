"""Rounding as a binary number rounds, and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sections import let

#: Splits a double into two halves of 26 bits.
SPLIT = float((1 << 27) + 1)


def exact_round(value: Column, digits: int = 2) -> Column:
    """A double rounded to ``digits`` by its exact binary value, halves to even: 2.675 gives 2.67, 0.125 gives 0.12.

    The product with 10**digits is taken with its rounding error, from halves of the factors, so the side of the half
    that it is on is known exactly. Values of 10**13 and more come out as they are, null and NaN too.
    """
    scale = float(10**digits)
    high = SPLIT * scale - (SPLIT * scale - scale)
    low = scale - high

    def of(x: Column) -> Column:
        def halves(p: Column) -> Column:
            big = SPLIT * x
            a = big - (big - x)
            error = low * (x - a) - (((p - a * high) - (x - a) * high) - a * low)
            return let(F.floor(p).cast("double"), lambda n: let((p - n - 0.5) + error, lambda side: F.when(side > 0, n + 1).when(side < 0, n).when(n % 2 == 0, n).otherwise(n + 1)))

        return let(x * scale, halves) / scale

    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) >= 1e13), v).otherwise(F.signum(v) * let(F.abs(v), of))


def product_round(value: Column, digits: int = 2) -> Column:
    """A double rounded by its product with 10**digits as a double, halves away from zero, as DuckDB's round does: 1.005 gives 1.0, as the product is below the half."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def fixed(value: Column, digits: int = 2) -> Column:
    """A number as text with ``digits`` decimals, rounded exactly."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))
