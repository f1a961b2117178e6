"""Raw layout, canonical line layout, and the declared target tables.

Money is DECIMAL from the first read on.  Unit prices keep four digits inside
the engine, because line totals are rounded once, after the multiplication; the
declared target type of a price is DECIMAL(10,2) and applies on load.

Times are wall-clock times without a zone (TIMESTAMP_NTZ), which is what the
raw file and the declared TIMESTAMP columns hold, so that no result depends on
the session's time zone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.DecimalType(14, 4)
MONEY = T.DecimalType(24, 2)

CORRUPT = "corrupt_record"

# Column names and order of the raw transaction file.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", PRICE),
        T.StructField("Customer ID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)

# What every source hands to the operators.
LINE_SCHEMA = T.StructType(
    [
        T.StructField("invoice_no", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("order_date", T.TimestampNTZType()),
        T.StructField("unit_price", PRICE),
        T.StructField("customer_id", T.IntegerType()),
        T.StructField("country", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Col:
    name: str
    type: str
    required: bool = True


@dataclass(frozen=True)
class Table:
    """A declared target table and the constraints it promises."""

    key: str
    name: str
    label: str
    columns: tuple[Col, ...]
    primary_key: str | None = None
    surrogate_key: str | None = None
    references: dict[str, str] = field(default_factory=dict)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def ddl_columns(self) -> str:
        return ", ".join(f"{c.name} {c.type}{' NOT NULL' if c.required else ''}" for c in self.columns)


# The target tables, their declared types, keys and display labels.
TABLES: dict[str, Table] = {
    t.key: t
    for t in (
        Table(
            "dim_customers",
            "dim_customers",
            "Dimension - Customers",
            (
                Col("customer_id", "INT"),
                Col("country", "VARCHAR(80)"),
                Col("customer_segment", "VARCHAR(40)", required=False),
            ),
            primary_key="customer_id",
        ),
        Table(
            "dim_products",
            "dim_products",
            "Dimension - Products",
            (
                Col("product_id", "VARCHAR(20)"),
                Col("product_name", "VARCHAR(150)"),
                Col("avg_unit_price", "DECIMAL(10,2)"),
            ),
            primary_key="product_id",
        ),
        Table(
            "fact_orders",
            "fact_orders",
            "Fact - Orders",
            (
                Col("order_id", "VARCHAR(20)"),
                Col("customer_id", "INT", required=False),
                Col("product_id", "VARCHAR(20)"),
                Col("order_date", "TIMESTAMP_NTZ"),
                Col("quantity", "INT"),
                Col("unit_price", "DECIMAL(10,2)"),
                Col("line_total", "DECIMAL(12,2)"),
                Col("order_status", "VARCHAR(20)"),
            ),
            surrogate_key="order_line_id",
            references={"customer_id": "dim_customers", "product_id": "dim_products"},
        ),
        Table(
            "revenue_summary",
            "analytics.revenue_summary",
            "Reporting - Revenue Summary",
            (
                Col("country", "VARCHAR(80)"),
                Col("month", "DATE"),
                Col("total_revenue", "DECIMAL(14,2)"),
                Col("total_orders", "INT"),
                Col("average_order_value", "DECIMAL(10,2)"),
            ),
            surrogate_key="summary_id",
        ),
        Table(
            "customer_retention",
            "analytics.customer_retention",
            "Reporting - Customer Retention",
            (
                Col("customer_id", "INT"),
                Col("total_orders", "INT"),
                Col("lifetime_spend", "DECIMAL(14,2)"),
                Col("first_order_date", "DATE"),
                Col("last_order_date", "DATE"),
                Col("customer_status", "VARCHAR(30)"),
            ),
            surrogate_key="retention_id",
            references={"customer_id": "dim_customers"},
        ),
        Table(
            "product_performance",
            "analytics.product_performance",
            "Reporting - Product Performance",
            (
                Col("product_id", "VARCHAR(20)"),
                Col("month", "DATE"),
                Col("units_sold", "INT"),
                Col("total_revenue", "DECIMAL(14,2)"),
                Col("overall_rank", "INT"),
            ),
            surrogate_key="performance_id",
            references={"product_id": "dim_products"},
        ),
    )
}


def _stored(column: Col) -> Column:
    c = F.col(column.name)
    if column.type.startswith("VARCHAR"):
        return c
    return c.cast(column.type).alias(column.name)


def conform(df: DataFrame, table: Table) -> DataFrame:
    """The frame in the table's declared column order and types, as a store holds it.

    A value its declared type cannot hold raises (Spark's ANSI casts), as the
    store itself would; text length is checked by the constraint audit.
    """
    return df.select(*[_stored(c) for c in table.columns])
