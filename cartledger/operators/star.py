"""The star schema: one fact table and two dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartledger.functions.money import line_total, per_unit
from cartledger.operators.quality import is_cancelling
from cartledger.schemas import MONEY

# The two states of an order.
COMPLETED, CANCELLED = "Completed", "Cancelled"


def fact_orders(unique_orders: DataFrame, *carried: str) -> DataFrame:
    """The fact table's columns, and those ``carried`` besides."""
    invoice = F.col("invoice_no")
    return unique_orders.select(
        invoice.alias("order_id"),
        "customer_id",
        F.col("stock_code").alias("product_id"),
        "order_date",
        "quantity",
        "unit_price",
        line_total(F.col("quantity"), F.col("unit_price")).alias("line_total"),
        F.when(is_cancelling(invoice), CANCELLED).otherwise(COMPLETED).alias("order_status"),
        *carried,
    )


def completed(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("order_status") == COMPLETED)


def product_names(clean_products: DataFrame) -> DataFrame:
    """One name per product: the last in binary order among its spellings."""
    return clean_products.groupBy(F.col("stock_code").alias("product_id")).agg(
        F.max("description").alias("product_name")
    )


def average_prices(fact: DataFrame) -> DataFrame:
    """Mean price over completed lines, divided exactly and rounded once."""
    mean = per_unit(F.sum("unit_price"), F.count("unit_price"))
    return completed(fact).groupBy("product_id").agg(mean.alias("avg_unit_price"))


def dim_products(names: DataFrame, prices: DataFrame) -> DataFrame:
    price = F.coalesce("avg_unit_price", F.lit(0).cast(MONEY))
    return names.join(prices, "product_id", "left").select("product_id", "product_name", price.alias("avg_unit_price"))


def customer_countries(clean_customers: DataFrame) -> DataFrame:
    """One country per customer: the last in binary order among its countries."""
    return clean_customers.groupBy("customer_id").agg(F.max("country").alias("country"))


def dim_customers(countries: DataFrame, segments: DataFrame) -> DataFrame:
    return countries.join(segments, "customer_id", "left").select("customer_id", "country", "customer_segment")
