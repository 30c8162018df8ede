"""Percentages and rounding as native columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52
_SCALE = 1 << _BITS
_HALF = _SCALE >> 1


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 as a double, 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def exact_round(x: Column, digits: int) -> Column:
    """Round a double the way correctly rounded decimal output does.

    Spark's `round` works on the shortest decimal text of the value and `bround` takes
    ties on that text, so both differ from rounding the stored binary value (2.675 is
    stored below the tie). Here the value is scaled by 2**52 into an integer, which is
    exact, and rounded half-even in integer arithmetic. The whole part is split off first,
    and what lies below the scale only tells whether a tie is one, so any magnitude is right.
    Values from 2**52 on have no fraction and stay as they are, as do infinities and NaN.
    """
    size = F.abs(x)
    whole = F.floor(F.least(size, F.lit(float(_SCALE))))
    scaled = (size - whole) * F.lit(float(_SCALE))
    units = F.floor(scaled)
    below = (scaled - units) * F.lit(float(10**digits))
    more = F.floor(below)
    if digits <= 3:
        shifted = units * F.lit(10**digits) + more + F.lit(_HALF)
        floor = F.shiftright(shifted, _BITS)
        rest = shifted.bitwiseAND(F.lit(_SCALE - 1))
    else:
        wide = units.cast("decimal(20,0)") * F.lit(Decimal(10**digits)) + more.cast("decimal(20,0)") + F.lit(Decimal(_HALF))
        floor = F.call_function("div", wide, F.lit(Decimal(_SCALE)))
        rest = wide % F.lit(Decimal(_SCALE))
    tie_to_odd = (rest == 0) & (below == more) & (floor.bitwiseAND(F.lit(1)) == 1)
    part = floor - F.when(tie_to_odd, F.lit(1)).otherwise(F.lit(0))
    ten = float(10**digits)
    joined = F.when(whole < int(2**53 / ten), (whole * F.lit(10**digits) + part).cast("double") / F.lit(ten)).otherwise(
        whole.cast("double") + part.cast("double") / F.lit(ten))
    rounded = F.when(size < F.lit(float(_SCALE)), joined).otherwise(size)
    return F.when(x < 0, -rounded).otherwise(rounded)


def fixed_text(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded by `exact_round`."""
    return F.format_string(f"%.{digits}f", exact_round(x, digits))


def short_float_text(x: Column) -> Column:
    """Shortest text of a double in plain notation, `75.0`-style."""
    return x.cast("double").cast("string")
