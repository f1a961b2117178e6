"""Month buckets and reference dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(moment: Column) -> Column:
    """First day of the month, as a DATE."""
    return F.trunc(moment.cast("date"), "month")


def year_month(moment: Column) -> Column:
    return F.date_format(moment.cast("date"), "yyyy-MM")


def latest(df: DataFrame, column: str) -> Column:
    """The column's maximum as a scalar subquery: it stays in the plan."""
    return df.agg(F.max(column)).scalar()
