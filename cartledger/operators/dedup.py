"""Duplicate removal over all history.

Two lines are the same when invoice, product, quantity and time agree.  Of
those the one with the smallest (customer, price) stays, customers without a
number last.  The choice is an aggregate, not a window: map tasks already
reduce a group of copies to one row each, so a group that holds a large part
of the data never meets in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartledger.operators.extracts import ORDER_COLUMNS
from cartledger.schemas import PRICE

IDENTITY = ["invoice_no", "stock_code", "quantity", "order_date"]
CHOICE = ["customer_id", "unit_price"]

_COPIES_PER_CHUNK = 100_000


# One number per choice, so that its minimum is a hash aggregate: customer, or one
# above all customers when there is none, then price in its fourth digits.
_PRICES = 10**15  # above the digits of a price on either side of zero
_CUSTOMERS = 2**31
_PACKED = "decimal(38,0)"


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(_PACKED)


def _preferred(of: Column | None = None) -> Column:
    """Smallest (customer, price), customers without a number last; of the rows that fulfil a condition, if given."""
    customer = F.coalesce(F.col("customer_id").cast("long"), F.lit(_CUSTOMERS)) + _CUSTOMERS
    price = F.coalesce((F.col("unit_price") * 10_000).cast("long") + _PRICES, F.lit(0))
    packed = (customer.cast("decimal(12,0)") * F.lit(str(2 * _PRICES)).cast("decimal(16,0)") + price.cast("decimal(20,0)")).cast(_PACKED)
    return F.min(packed if of is None else F.when(of, packed))


def _unpacked(kept: str) -> list[Column]:
    number = F.call_function("div", F.col(kept), _number(2 * _PRICES))
    price = (F.col(kept) - number.cast("decimal(12,0)") * F.lit(str(2 * _PRICES)).cast("decimal(16,0)")).cast("long")
    customer = number - _CUSTOMERS
    return [
        F.when(customer < _CUSTOMERS, customer).cast("int").alias("customer_id"),
        F.when(price != 0, ((price - _PRICES).cast("decimal(18,0)") / 10_000).cast(PRICE)).alias("unit_price"),
    ]


def _agree(left: list[str], right: list[str]) -> Column:
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)))


def unique_lines(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy(*IDENTITY)
        .agg(_preferred().alias("kept"))
        .select(*IDENTITY, *_unpacked("kept"))
        .select(*ORDER_COLUMNS)
    )


def merged_lines(known: DataFrame, arriving: DataFrame) -> DataFrame:
    """:func:`unique_lines` of both, with a mark on lines that ``known`` does not have or has with another choice."""
    both = known.withColumn("known", F.lit(True)).unionByName(arriving.withColumn("known", F.lit(False)))
    merged = both.groupBy(*IDENTITY).agg(_preferred().alias("kept"), _preferred(F.col("known")).alias("before"))
    changed = ~F.col("kept").eqNullSafe(F.col("before"))
    return merged.select(*IDENTITY, *_unpacked("kept"), changed.alias("changed")).select(*ORDER_COLUMNS, "changed")


def removed_lines(orders: DataFrame) -> DataFrame:
    """Every line that :func:`unique_lines` leaves out, each as often as it occurs.

    Copies are counted rather than moved, and only groups with more than one
    line are looked at again.
    """
    counted = orders.groupBy(*IDENTITY, *CHOICE).agg(F.count(F.lit(1)).alias("copies"))
    repeated = (
        counted.groupBy(*IDENTITY)
        .agg(_preferred().alias("kept"), F.sum("copies").alias("lines"))
        .where("lines > 1")
        .select(*IDENTITY, F.struct(*_unpacked("kept")).alias("kept"), "lines")
    )
    same_group = _agree([f"l.{c}" for c in IDENTITY], [f"r.{c}" for c in IDENTITY])
    is_kept = _agree([f"l.{c}" for c in CHOICE], [f"r.kept.{c}" for c in CHOICE])
    surplus = (
        counted.alias("l")
        .join(repeated.alias("r"), same_group)
        .select("l.*", (F.col("copies") - is_kept.cast("long")).alias("surplus"))
        .where("surplus > 0")
    )
    return _repeat(surplus, "surplus").select(*ORDER_COLUMNS)


def _repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, written out in chunks that spread over the cluster."""
    keys = [c for c in df.columns if c != times]
    last_chunk = F.expr(f"({times} - 1) div {_COPIES_PER_CHUNK}")
    left_over = F.col(times) - F.col("chunk") * _COPIES_PER_CHUNK
    return (
        df.select("*", F.explode(F.sequence(F.lit(0), last_chunk)).alias("chunk"))
        .withColumn("in_chunk", F.least(F.lit(_COPIES_PER_CHUNK), left_over).cast("int"))
        .repartition(*keys, "chunk")
        .select(*keys, F.explode(F.array_repeat(F.lit(True), F.col("in_chunk"))).alias("copy"))
        .drop("copy")
    )
