"""Rounding, exact sums and null filling that any engine reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of this size and beyond, infinities and NaN are added as doubles, not as decimals.
LARGE = 1e17


def rounded(value: Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same steps on doubles everywhere.

    Values that have no such digit (from 2^53 / 10^d on), infinities, NaN and null stay as they are.
    """
    power, value = 10.0**digits, value.cast("double")
    return F.when(F.abs(value) < 2.0**53 / power, F.floor(value * power + 0.5) / power).otherwise(value)


def exact_sum(value: Column, scale: int = 10) -> Column:
    """A sum that doesn't depend on the order of the rows: through decimals of ``scale`` places; of no value 0.

    Values from 1e17 on are added as doubles: there the order may move the last
    digit. Infinities and NaN give what they give in a sum of doubles.
    """
    value = value.cast("double")
    small = F.abs(value) < LARGE
    exact = F.coalesce(F.sum(F.when(small, value).cast(f"decimal(28,{scale})")).cast("double"), F.lit(0.0))
    return exact + F.coalesce(F.sum(F.when(~small, value)), F.lit(0.0))


def filled(value: Column, default: float = 0.0) -> Column:
    """Null and NaN become ``default``."""
    return F.coalesce(F.nanvl(value, F.lit(default)), F.lit(default))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is null or not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)
