"""Raw lines split into the customer, product and order extracts.

The first two keep every raw line's customer and product, also those of lines
that later fail validation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartledger.functions.text import product_title, title_case

ORDER_COLUMNS = ["invoice_no", "customer_id", "stock_code", "order_date", "quantity", "unit_price"]


def customers(lines: DataFrame) -> DataFrame:
    return lines.where("customer_id IS NOT NULL").select("customer_id", "country").distinct()


def products(lines: DataFrame) -> DataFrame:
    return lines.where("stock_code IS NOT NULL").select("stock_code", "description").distinct()


def orders(lines: DataFrame) -> DataFrame:
    return lines.select(*ORDER_COLUMNS)


def clean_customers(extract: DataFrame) -> DataFrame:
    """Tidy country names; one row per customer and raw spelling, as extracted."""
    return extract.withColumn("country", title_case(F.col("country")))


def clean_products(extract: DataFrame) -> DataFrame:
    return extract.withColumn("description", product_title(F.col("description")))
