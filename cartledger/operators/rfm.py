"""Customer segments from recency, frequency and money spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartledger.operators.selection import tiles
from cartledger.staging import StageArea

# Number of tiles, and the segments as lowest and highest scores
# (recency, frequency, monetary).  The first segment that fits is given.
TILES = 5
ANY = (1, TILES)
SEGMENTS: list[tuple[str, tuple[int, int], tuple[int, int], tuple[int, int]]] = [
    # name         recency  frequency  monetary
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal", ANY, (3, 5), (3, 5)),
    ("New", (4, 5), (1, 2), ANY),
    ("At Risk", (1, 2), (3, 5), ANY),
    ("Lapsed", (1, 2), (1, 2), ANY),
]
OTHERWISE = "Repeat"


def metrics(customer_orders: DataFrame) -> DataFrame:
    """Per customer with a completed order: last day, number of orders, money spent.

    The last day stands for recency: the days since then fall exactly as the
    day rises, whatever the reference date.
    """
    return (
        customer_orders.where("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(
            F.max("last_line").cast("date").alias("last_day"),
            F.count("order_id").alias("frequency"),
            F.sum("spent").alias("monetary"),
        )
    )


def scores(staged_metrics: DataFrame) -> DataFrame:
    """Three tile numbers per customer; equal values are ordered by customer."""
    return tiles(staged_metrics, TILES, {"r_score": "last_day", "f_score": "frequency", "m_score": "monetary"}, "customer_id")


def segment_of(recency: Column, frequency: Column, monetary: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, *ranges in reversed(SEGMENTS):
        fits = F.lit(True)
        for score, (low, high) in zip((recency, frequency, monetary), ranges):
            fits = fits & score.between(low, high)
        found = F.when(fits, F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(OTHERWISE))


def segments(customer_orders: DataFrame, stage: StageArea) -> DataFrame:
    scored = scores(stage.table(metrics(customer_orders), "rfm_metrics"))
    segment = segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    return scored.select("customer_id", segment.alias("customer_segment"))
