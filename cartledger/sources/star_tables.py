"""Retail lines derived from order tables (lineitem, orders, customer, nation, part).

Every line of ``lineitem`` becomes one raw retail line.  Those tables are
clean, so a fixed share of lines gets the defects that real files have: missing
and blank codes, zero and missing quantities, negative prices, anonymous
customers, customers with two countries, several spellings of one product, and
repeated lines.  No line is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.params import Params
from cartledger.schemas import LINE_SCHEMA

# The tables cover other years than the retail file.
PARAMS = Params(window_start="1995-02-01 00:00:00", window_end="2001-06-30 23:59:59")

# Declared, not inferred: reading needs no look at the files first.
SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "nation": "n_nationkey INT, n_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_retailprice DOUBLE",
}


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    t = {name: spark.read.schema(columns).parquet(f"{folder}/{name}.parquet") for name, columns in SCHEMAS.items()}
    # Orders meet their customers first, so that lines are joined (and, when the
    # tables are large, shuffled) once for all that an order knows.  Values that
    # depend on one table alone are computed there.
    buys = (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            "o_orderkey",
            F.when(F.col("o_custkey") % 20 != 0, F.col("o_custkey")).cast("int").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            F.when((F.col("o_custkey") % 30 == 1) & (F.col("o_orderkey") % 2 == 0), " france ")
            .otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")))
            .alias("country"),
        )
    )
    goods = t["part"].select(
        "p_partkey",
        F.concat(F.lit(" "), F.upper("p_name")).alias("title"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("list_price"),
    )
    joined = (
        t["lineitem"]
        .join(buys, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(goods, F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    returned = F.col("l_returnflag") == "R"
    line_no, part_no = F.col("l_linenumber"), F.col("l_partkey")
    price = F.round(F.col("list_price") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)
    values: dict[str, Column] = {
        "invoice_no": F.concat(
            F.when(returned & (F.col("l_linestatus") == "F"), "C").otherwise(""), F.col("l_orderkey").cast("string")
        ),
        "stock_code": F.when((part_no % 211 == 0) & (line_no == 1), F.lit(None))
        .when((part_no % 223 == 0) & (line_no == 2), " ")
        .otherwise(part_no.cast("string")),
        "description": F.when(part_no % 50 == 0, "  ").otherwise(
            F.concat("title", F.when((part_no % 40 == 1) & (line_no == 1), " b ").otherwise(" "))
        ),
        "quantity": F.when((line_no == 7) & (part_no % 29 == 0), F.lit(None))
        .when((line_no == 6) & (part_no % 31 == 0), 0)
        .when(returned, -F.col("l_quantity"))
        .otherwise(F.col("l_quantity")),
        "order_date": F.col("order_date"),
        "unit_price": F.when((line_no == 3) & (part_no % 37 == 0), -price).otherwise(price),
        "customer_id": F.col("customer_id"),
        "country": F.col("country"),
    }
    typed = [values[f.name].cast(f.dataType).alias(f.name) for f in LINE_SCHEMA.fields]
    times = F.when(F.col("customer_id") % 25 == 1, 2).otherwise(1)
    return joined.select(*typed).select("*", F.explode(F.array_repeat(F.lit(True), times)).alias("copy")).drop("copy")
