"""Rounding of doubles that doesn't write every number as a decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance from a tie, in units of the last digit, and size in these units, up to which ``F.round`` decides.
TIE, LARGE = 1e-3, float(1 << 36)


def round_double(value: Column | str, digits: int) -> Column:
    """Equal to ``F.round`` of a double, which goes through a decimal's text; only numbers next to a tie and very large ones do so here.

    Away from ties the scaled number's error (2^-16 at most) can't change the nearest integer, and dividing that by a
    power of ten gives the double nearest to the decimal.
    """
    x = F.col(value) if isinstance(value, str) else value
    unit = F.lit(10.0**digits)
    scaled = x * unit
    rest = scaled - F.floor(scaled)
    plain = (F.abs(scaled) < LARGE) & (F.abs(rest - 0.5) > TIE)
    return F.when(plain, F.floor(scaled + 0.5) / unit).otherwise(F.round(x, digits))
