"""Normal and chi-square tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev coefficients of the complementary error function
# (Numerical Recipes "erfcc", relative error below 1.2e-7).
ERFC_COEFFICIENTS = [
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
]


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + z / F.lit(2.0))
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * t + F.lit(coefficient)
    return t * F.exp(poly - z * z)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi_square_1df_p(chi2: Column) -> Column:
    return erfc(F.sqrt(chi2 / F.lit(2.0)))
