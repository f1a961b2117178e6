"""The reporting queries: each a function from a warehouse to one lazy frame.

Reports that need a customer's country or segment first sum lines per customer,
then join: the join moves one row per customer (and month, order or product)
and a customer with very many lines is reduced before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartledger.functions.dates import month_of
from cartledger.functions.money import per_unit, total
from cartledger.operators import distinct
from cartledger.operators.ranking import dense_rank
from cartledger.schemas import MONEY
from cartledger.warehouse import Warehouse


def _sum_lines(w: Warehouse, *keys: str | Column) -> DataFrame:
    return w.completed.groupBy(*keys).agg(total(F.col("line_total")).alias("total_revenue"))


def _customer_sums(w: Warehouse, *keys: str | Column) -> DataFrame:
    """Completed revenue per customer and ``keys``, with the customer's country."""
    known = w.completed.where("customer_id IS NOT NULL")
    sums = known.groupBy("customer_id", *keys).agg(total(F.col("line_total")).alias("total_revenue"))
    return sums.join(w.countries, "customer_id")


def _resum() -> Column:
    return total(F.col("total_revenue")).alias("total_revenue")


# -- totals


def total_revenue(w: Warehouse) -> DataFrame:
    return _sum_lines(w)


def total_orders(w: Warehouse) -> DataFrame:
    return w.completed.agg(F.countDistinct("order_id").alias("total_orders"))


def kpi_metrics(w: Warehouse) -> DataFrame:
    """Five figures in one row, from one aggregate per table."""
    sales = w.customer_orders.agg(
        F.struct(total(F.col("order_total")).alias("revenue"), F.countDistinct("order_id").alias("orders")).alias("v")
    ).scalar()
    customers = w.countries.agg(F.countDistinct("customer_id")).scalar()
    retention = w.customer_retention.agg(
        F.struct(F.count_if(F.col("total_orders") >= 2).alias("repeat"), F.count(F.lit(1)).alias("all")).alias("v")
    ).scalar()
    return w.spark.range(1).select(
        sales["revenue"].alias("total_revenue"),
        sales["orders"].alias("total_orders"),
        customers.alias("total_customers"),
        retention["repeat"].alias("repeat_customers"),
        retention["all"].alias("total_retention_customers"),
    )


# -- customers


def avg_order_value_per_segment(w: Warehouse) -> DataFrame:
    segment_orders = w.customer_orders.join(w.dim_customers, "customer_id").groupBy("customer_segment")
    value = per_unit(F.sum("order_total"), F.countDistinct("order_id"))
    return segment_orders.agg(value.alias("average_order_value")).orderBy(
        F.col("average_order_value").desc_nulls_last(), F.col("customer_segment").asc_nulls_last()
    )


def consecutive_months_purchasers(w: Warehouse) -> DataFrame:
    """Customers with completed orders in two months that follow each other.

    After the distinct a customer has one row per month, so the window groups
    stay small however many lines a customer has.
    """
    day = F.col("order_date").cast("date")
    months = (
        w.completed.where("customer_id IS NOT NULL")
        .select("customer_id", (F.year(day) * 12 + F.month(day)).alias("month_no"))
        .distinct()
    )
    previous = F.lag("month_no").over(Window.partitionBy("customer_id").orderBy("month_no"))
    return (
        months.select("customer_id", (F.col("month_no") - previous).alias("gap"))
        .where("gap = 1")
        .select("customer_id")
        .distinct()
    )


def customer_segment_distribution(w: Warehouse) -> DataFrame:
    return (
        w.dim_customers.where("customer_segment IS NOT NULL")
        .groupBy("customer_segment")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_10_customers(w: Warehouse) -> DataFrame:
    return (
        _customer_sums(w)
        .select("customer_id", "country", F.col("total_revenue").alias("lifetime_spend"))
        .orderBy(F.desc("lifetime_spend"), "customer_id")
        .limit(10)
    )


# -- countries and months


def revenue_per_country(w: Warehouse) -> DataFrame:
    by_country = _customer_sums(w).groupBy("country").agg(_resum())
    return by_country.orderBy(F.desc("total_revenue"), F.col("country").asc_nulls_last())


def heatmap_revenue(w: Warehouse) -> DataFrame:
    return w.revenue_summary.groupBy("country", "month").agg(total(F.col("total_revenue")).alias("revenue"))


def monthly_revenue_trends(w: Warehouse) -> DataFrame:
    by_month = _customer_sums(w, month_of(F.col("order_date")).alias("first_day"))
    return (
        by_month.groupBy("country", "first_day")
        .agg(_resum())
        .select("country", F.year("first_day").alias("year"), F.month("first_day").alias("month"), "total_revenue")
    )


def running_total_revenue(w: Warehouse) -> DataFrame:
    """The window runs over one row per month of the accepted date window."""
    so_far = Window.orderBy("revenue_month").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _sum_lines(w, month_of(F.col("order_date")).alias("revenue_month"))
        .withColumnRenamed("total_revenue", "monthly_revenue")
        .withColumn("running_total", F.sum("monthly_revenue").over(so_far).cast(MONEY))
        .orderBy("revenue_month")
    )


# -- orders


def order_status_distribution(w: Warehouse) -> DataFrame:
    return w.fact.groupBy("order_status").agg(F.countDistinct("order_id").alias("total_orders"))


def order_value_distribution(w: Warehouse) -> DataFrame:
    values = w.completed.groupBy("order_id").agg(total(F.col("line_total")).alias("order_value"))
    return values.where("order_value > 0")


# -- products


def product_revenue(w: Warehouse) -> DataFrame:
    named = _sum_lines(w, "product_id").join(w.product_names, "product_id")
    return named.select("product_id", "product_name", "total_revenue")


def product_revenue_ranking(w: Warehouse) -> DataFrame:
    staged = w.stage.table(product_revenue(w), "product_revenue")
    return dense_rank(staged, "total_revenue", "revenue_rank", w.stage)


def product_units_sold(w: Warehouse) -> DataFrame:
    sums = w.product_months.groupBy("product_id").agg(F.sum("units_sold").alias("total_units"), _resum())
    return sums.join(w.product_names, "product_id").select(
        "product_id", "product_name", "total_units", "total_revenue"
    )


def no_sales_last_60_days(w: Warehouse) -> DataFrame:
    """Products without a line, of whatever status, in the days before the latest line."""
    recent = w.products_sold_within(w.params.quiet_days)
    return w.product_names.join(recent, "product_id", "left_anti").select("product_id", "product_name")


def top_product_per_country(w: Warehouse) -> DataFrame:
    """Best-selling product of each country; ties all stay.

    The maximum is an aggregate that is met again by an equality join, so a
    country's products never gather in one task.
    """
    sales = (
        _customer_sums(w, "product_id")
        .groupBy("country", "product_id")
        .agg(_resum())
        .join(w.product_names, "product_id")
    )
    sales = w.stage.table(sales, "country_products")
    best = sales.groupBy(F.col("country").alias("best_country")).agg(F.max("total_revenue").alias("best_revenue"))
    is_best = F.col("country").eqNullSafe(F.col("best_country")) & (F.col("total_revenue") == F.col("best_revenue"))
    return (
        sales.join(best, is_best)
        .select("country", "product_id", "product_name", "total_revenue", F.lit(1).alias("product_rank"))
        .orderBy(F.col("country").asc_nulls_last(), "product_id")
    )


def rolling_orders(w: Warehouse, months: int = 3) -> DataFrame:
    """Distinct orders per country in the months up to each month, from the warehouse's bitmaps."""
    return distinct.rolling(w.order_bitmaps, months).select("country", F.col("until").alias("year_month"), "total_orders")
