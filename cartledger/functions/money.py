"""Exact decimal money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartledger.schemas import MONEY


def line_total(quantity: Column, unit_price: Column) -> Column:
    """Rounded once, and wide: the declared type applies on load."""
    return F.round(quantity * unit_price, 2).cast(MONEY)


def total(amount: Column) -> Column:
    """Sum of money, wide enough for any number of lines this engine will see."""
    return F.sum(amount).cast(MONEY)


def per_unit(amount: Column, units: Column) -> Column:
    """``amount / units`` rounded half up to cents; null when there are no units.

    The operand types leave the quotient 18 digits after the point.  With wider
    ones Spark would round it to six first, and a second time here.
    """
    quotient = F.try_divide(amount.cast("decimal(24,4)"), units.cast("decimal(18,0)"))
    return F.round(quotient, 2).cast(MONEY)
