"""Exact distinct order counts over any range of months, added up from bitmaps.

Distinct counts of months cannot be added; bitmaps of them can be united.  Every
order gets a dense number once; a month and country keep the set of their orders'
numbers as bitmaps of 32,768 numbers each.  The orders of a country and time are
numbered together, so that a month's set fills few bitmaps.  A range of months is
the union of its bitmaps and the number of their bits; no line is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartledger.operators.ranking import row_index
from cartledger.sources.curated import MONTH
from cartledger.staging import StageArea

NUMBER, BUCKET, BITS = "order_no", "bitmap_no", "orders"


def new_numbers(month_orders: DataFrame, countries: DataFrame, known: DataFrame | None, stage: StageArea) -> DataFrame:
    """(order_id, order_no) of the orders that have no number yet, numbered after those that have one.

    ``month_orders`` has year_month, customer_id and order_id; orders of unknown
    customers have no country and come first.
    """
    orders = (
        month_orders.join(countries, "customer_id", "left")
        .groupBy("order_id")
        .agg(F.min("country").alias("country"), F.min(MONTH).alias("month"))
    )
    used = F.lit(0)
    if known is not None:
        orders = orders.join(known.select("order_id"), "order_id", "left_anti")
        used = F.coalesce(known.agg(F.max(NUMBER) + 1).scalar(), F.lit(0))
    order = [F.col(c).asc_nulls_first() for c in ("country", "month", "order_id")]
    placed = row_index(stage.table(orders, "order_numbers"), order, stage, NUMBER)
    return placed.select("order_id", (F.col(NUMBER) + used).alias(NUMBER))


def month_bitmaps(month_orders: DataFrame, countries: DataFrame, numbers: DataFrame) -> DataFrame:
    """(year_month, country, bitmap_no, orders): the orders of known customers, by month and country."""
    found = (
        month_orders.where("customer_id IS NOT NULL")
        .join(countries, "customer_id")
        .select(MONTH, "country", "order_id")
        .distinct()
        .join(numbers, "order_id")
    )
    return found.groupBy(MONTH, "country", F.bitmap_bucket_number(NUMBER).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias(BITS)
    )


def distinct_orders(bitmaps: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Distinct orders of the bitmaps given, in groups; filter by month or country first."""
    keys = [F.col(k) if isinstance(k, str) else k for k in by]
    united = bitmaps.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    names = [c for c in united.columns if c not in (BUCKET, BITS)]
    counted = united.groupBy(*names).agg(F.sum(F.bitmap_count(BITS)).alias("total_orders"))
    return counted.select(*names, F.coalesce("total_orders", F.lit(0)).alias("total_orders"))


def between(bitmaps: DataFrame, first: str, last: str) -> DataFrame:
    """The bitmaps of the months from ``first`` to ``last`` (yyyy-MM), both included."""
    return bitmaps.where(F.col(MONTH).between(first, last))


def rolling(bitmaps: DataFrame, months: int) -> DataFrame:
    """Distinct orders per country in the ``months`` months up to each month that has any order."""
    own = F.to_date(F.concat(MONTH, F.lit("-01")))
    last = bitmaps.agg(F.max(own)).scalar()
    ends = bitmaps.withColumn("until", F.explode(F.sequence(own, F.add_months(own, months - 1), F.expr("INTERVAL 1 MONTH"))))
    ends = ends.where(F.col("until") <= last).withColumn("until", F.date_format("until", "yyyy-MM"))
    return distinct_orders(ends, ["country", "until"])
