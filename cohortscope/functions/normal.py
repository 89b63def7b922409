"""Two-sided normal tail probability as a column expression (Spark SQL has no erf)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
ERFC_P = 0.3275911
ERFC_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * x)
    total = F.lit(0.0)
    for coefficient in reversed(ERFC_COEFFICIENTS):
        total = (total + F.lit(coefficient)) * t
    return total * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    """Probability of a standard normal at least as far from 0 as ``z``."""
    return F.least(erfc(F.abs(z) / F.sqrt(F.lit(2.0))), F.lit(1.0))
