"""Scalar and aggregate helpers on Columns.

Sums of money are taken over whole numbers of a fixed scale, so a result doesn't
depend on the order in which partitions arrive. An overflow of 64 bits raises.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def fixed(x: Column, digits: int = 2) -> Column:
    """A double as a whole number of 10 ** -digits, half up."""
    return F.floor(x * float(10**digits) + 0.5).cast("long")


def fixed_sum(x: Column | str, digits: int = 2) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(fixed(x, digits)).cast("double") / float(10**digits)


def fixed_avg(x: Column | str, digits: int = 2) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(fixed(x, digits)).cast("double") / float(10**digits) / F.count(x)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom is positive, else null."""
    return F.when(bottom > 0, top / bottom)


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounding half up by way of a decimal, as people round money."""
    return F.round(x.cast(f"decimal(28,{digits + 4})"), digits)


def share(x: Column, *by: str, digits: int = 4) -> Column:
    """x as a share of its total over all rows, or over the rows of ``by``; exact like ``fixed_sum``."""
    whole = fixed(x, digits)
    return F.try_divide(whole, F.sum(whole).over(Window.partitionBy(*by)))


def sum_if(condition: Column, x: Column | int = 1) -> Column:
    return F.sum(F.when(condition, x).otherwise(0)).cast("long")
