"""The tables a report can ask for, each built from lines or read from storage.

A warehouse is a set of lazy frames.  Built from raw lines, a table's plan
reaches down to the source; opened on a curated folder, it is a scan.  Reports
only see the names below and work on either.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.functions.dates import latest, year_month
from cartledger.operators import dedup, distinct, extracts, marts, quality, rfm, star
from cartledger.operators.quality import Rule
from cartledger.params import Params
from cartledger.schemas import TABLES
from cartledger.sources import curated
from cartledger.staging import StageArea


class Warehouse:
    """Tables over raw lines.

    ``rules`` replaces the validation rules; ``segmenter`` replaces the customer
    segments (fact table in, one row of customer_id and customer_segment out).
    """

    def __init__(
        self,
        lines: DataFrame,
        params: Params = Params(),
        rules: Sequence[Rule] | None = None,
        segmenter: Callable[[DataFrame], DataFrame] | None = None,
        stage: StageArea | None = None,
    ):
        if stage is not None:
            self.stage = stage
        self.lines = lines
        self.spark: SparkSession = lines.sparkSession
        self.params = params
        self.rules = list(rules) if rules is not None else quality.default_rules(params)
        self._segmenter = segmenter

    @cached_property
    def stage(self) -> StageArea:
        return StageArea.of(self.spark)

    # -- lines

    @cached_property
    def orders(self) -> DataFrame:
        return extracts.orders(self.lines)

    @cached_property
    def valid_orders(self) -> DataFrame:
        return quality.valid(self.orders, self.rules)

    @cached_property
    def unique_orders(self) -> DataFrame:
        return dedup.unique_lines(self.valid_orders)

    # -- star schema

    @cached_property
    def fact(self) -> DataFrame:
        return star.fact_orders(self.unique_orders)

    @cached_property
    def completed(self) -> DataFrame:
        return star.completed(self.fact)

    @cached_property
    def countries(self) -> DataFrame:
        """customer_id and country: the customer dimension without its segments."""
        return star.customer_countries(extracts.clean_customers(extracts.customers(self.lines)))

    @cached_property
    def product_names(self) -> DataFrame:
        """product_id and product_name: the product dimension without its prices."""
        return star.product_names(extracts.clean_products(extracts.products(self.lines)))

    @cached_property
    def segments(self) -> DataFrame:
        if self._segmenter is not None:
            return self._segmenter(self.fact)
        return rfm.segments(self.customer_orders, self.stage)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return star.dim_customers(self.countries, self.segments)

    @cached_property
    def dim_products(self) -> DataFrame:
        return star.dim_products(self.product_names, star.average_prices(self.fact))

    # -- marts

    @cached_property
    def customer_orders(self) -> DataFrame:
        """Completed orders per customer; staged, because several tables start here."""
        return self.stage.table(marts.customer_orders(self.fact), "customer_orders")

    def products_sold_within(self, days: int) -> DataFrame:
        """product_id of every line, of whatever status, in the days before the latest one.

        Duplicates share product and time, so valid lines will do, and one pass
        to the last line of each product gives both dates.
        """
        last = self.valid_orders.groupBy(F.col("stock_code").alias("product_id")).agg(F.max("order_date").alias("last_line"))
        last = self.stage.table(last, "last_lines")
        since = latest(last, "last_line") - F.make_dt_interval(days=F.lit(days))
        return last.where(F.col("last_line") >= since).select("product_id")

    @cached_property
    def order_bitmaps(self) -> DataFrame:
        """The numbers of each month's and country's completed orders."""
        orders = star.completed(self.fact).select(year_month(F.col("order_date")).alias(curated.MONTH), "customer_id", "order_id")
        orders = self.stage.table(orders.distinct(), "month_orders")
        numbers = self.stage.table(distinct.new_numbers(orders, self.countries, None, self.stage), "order_numbers")
        return distinct.month_bitmaps(orders, self.countries, numbers)

    @cached_property
    def revenue_summary(self) -> DataFrame:
        return marts.revenue_summary(self.fact, self.countries)

    @cached_property
    def customer_retention(self) -> DataFrame:
        return marts.customer_retention(self.customer_orders, self.params)

    @cached_property
    def product_months(self) -> DataFrame:
        """The product mart without its rank."""
        return marts.product_months(self.fact)

    @cached_property
    def product_performance(self) -> DataFrame:
        staged = self.stage.table(self.product_months, "product_months")
        return marts.product_performance(staged, self.stage)

    def table(self, key: str) -> DataFrame:
        if key not in TABLES:
            raise KeyError(key)
        return self.fact if key == "fact_orders" else getattr(self, key)

    def stored(self) -> dict[str, DataFrame]:
        """Every table, computed once, for whoever reads several of them several times."""
        w = self.settle()
        others = {key: w.table(key) for key in TABLES if key != "fact_orders"}
        return {"fact_orders": w.fact, **w.stage.tables(others)}

    def settle(self) -> "Warehouse":
        """Compute lines, fact table and countries once, so that several tables can be built from them."""
        source = Warehouse(self.stage.table(self.lines, "lines"), self.params, self.rules, self._segmenter, self.stage)
        settled = source.on_fact(self.stage.table(source.fact, "fact"))
        settled.countries = self.stage.table(source.countries, "countries")
        return settled

    def on_fact(self, fact: DataFrame) -> "Warehouse":
        """The same warehouse over a fact table that has been written."""
        settled = Warehouse(self.lines, self.params, self.rules, self._segmenter, self.stage)
        settled.fact = fact
        return settled

    def counted(self, key: str) -> DataFrame:
        """A frame with as many rows as the table, without the columns that take most work."""
        smaller = {"dim_customers": "countries", "dim_products": "product_names", "product_performance": "product_months"}
        return getattr(self, smaller[key]) if key in smaller else self.table(key)


class CuratedWarehouse(Warehouse):
    """The same tables, read from a curated folder."""

    def __init__(self, spark: SparkSession, root: str, params: Params = Params()):
        self.spark = spark
        self.root = root
        self.params = curated.params_of(spark, root, params)

    def _read(self, key: str) -> DataFrame:
        return curated.read_table(self.spark, self.root, key)

    @cached_property
    def fact(self) -> DataFrame:
        return self._read("fact_orders").drop(curated.MONTH)

    @cached_property
    def customer_orders(self) -> DataFrame:
        return marts.customer_orders(self.fact)

    def products_sold_within(self, days: int) -> DataFrame:
        since = latest(self.fact, "order_date") - F.make_dt_interval(days=F.lit(days))
        fact = curated.since(self._read("fact_orders"), since)
        return fact.select("product_id").distinct()

    def counted(self, key: str) -> DataFrame:
        return self.table(key)

    dim_customers = cached_property(lambda self: self._read("dim_customers"))
    dim_products = cached_property(lambda self: self._read("dim_products"))
    revenue_summary = cached_property(lambda self: self._read("revenue_summary"))
    customer_retention = cached_property(lambda self: self._read("customer_retention"))
    product_performance = cached_property(lambda self: self._read("product_performance"))

    @cached_property
    def countries(self) -> DataFrame:
        return self.dim_customers.select("customer_id", "country")

    @cached_property
    def product_names(self) -> DataFrame:
        return self.dim_products.select("product_id", "product_name")

    @cached_property
    def segments(self) -> DataFrame:
        return self.dim_customers.select("customer_id", "customer_segment").where("customer_segment IS NOT NULL")

    @cached_property
    def product_months(self) -> DataFrame:
        return self.product_performance.drop("overall_rank")

    def stored(self) -> dict[str, DataFrame]:
        return {key: self.table(key) for key in TABLES}

    def settle(self) -> "CuratedWarehouse":
        return self
