"""The three aggregate tables built from the fact table.

Lines of customers are summed per order before they meet the customer table, so
the join moves orders, not lines, and neither a customer nor a country with a
large share of the lines piles up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartledger.functions.dates import latest, month_of
from cartledger.functions.money import per_unit, total
from cartledger.operators.ranking import dense_rank
from cartledger.operators.star import completed
from cartledger.params import Params
from cartledger.schemas import TABLES
from cartledger.staging import StageArea


def customer_orders(fact: DataFrame) -> DataFrame:
    """Completed lines summed per customer and order, anonymous ones included.

    All figures per customer are built from this table.  ``spent`` is the money
    before line totals are rounded.
    """
    return (
        completed(fact)
        .groupBy("customer_id", "order_id")
        .agg(
            total(F.col("line_total")).alias("order_total"),
            F.sum(F.col("quantity") * F.col("unit_price")).alias("spent"),
            F.min("order_date").alias("first_line"),
            F.max("order_date").alias("last_line"),
        )
    )


def revenue_summary(fact: DataFrame, countries: DataFrame) -> DataFrame:
    per_customer = (
        completed(fact)
        .where("customer_id IS NOT NULL")
        .groupBy("customer_id", month_of(F.col("order_date")).alias("month"), "order_id")
        .agg(total(F.col("line_total")).alias("order_total"))
    )
    by_country = per_customer.join(countries, "customer_id").groupBy("country", "month")
    return by_country.agg(
        total(F.col("order_total")).alias("total_revenue"),
        F.countDistinct("order_id").alias("total_orders"),
    ).select(
        "*", per_unit(F.col("total_revenue"), F.col("total_orders")).alias("average_order_value")
    ).select(*TABLES["revenue_summary"].column_names)


def customer_retention(orders: DataFrame, params: Params) -> DataFrame:
    """From :func:`customer_orders`.  The reference date also counts anonymous lines."""
    per_customer = (
        orders.where("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            total(F.col("order_total")).alias("lifetime_spend"),
            F.min("first_line").cast("date").alias("first_order_date"),
            F.max("last_line").cast("date").alias("last_order_date"),
        )
    )
    days_away = F.datediff(latest(orders, "last_line").cast("date"), F.col("last_order_date"))
    status = (
        F.when(F.col("total_orders") == 1, "New")
        .when(days_away > params.lapsed_after_days, "Lapsed")
        .otherwise("Repeat")
    )
    return per_customer.withColumn("customer_status", status)


def product_months(fact: DataFrame) -> DataFrame:
    return (
        completed(fact)
        .groupBy("product_id", month_of(F.col("order_date")).alias("month"))
        .agg(
            F.sum("quantity").alias("units_sold"),
            total(F.col("line_total")).alias("total_revenue"),
        )
    )


def product_performance(staged_product_months: DataFrame, stage: StageArea) -> DataFrame:
    return dense_rank(
        staged_product_months, "total_revenue", "overall_rank", stage, within=["month"]
    ).select(*TABLES["product_performance"].column_names)
