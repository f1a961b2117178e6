"""Reading the curated zone back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.functions.dates import year_month
from cartledger.params import Params
from cartledger.schemas import TABLES

MONTH = "year_month"
SETTINGS = "settings"

# Folder of each table below the curated root.
FOLDERS = {key: table.name.replace(".", "/") for key, table in TABLES.items()}


def read_table(spark: SparkSession, root: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{FOLDERS[key]}")


def write_params(spark: SparkSession, root: str, params: Params) -> None:
    """Keep the date window with the zone: reports shape their columns by it."""
    row = spark.createDataFrame([(params.window_start, params.window_end)], "window_start string, window_end string")
    row.write.mode("overwrite").json(f"{root.rstrip('/')}/{SETTINGS}")


def params_of(spark: SparkSession, root: str, params: Params) -> Params:
    """The caller's settings with the zone's own date window, where it has one."""
    try:
        found = spark.read.schema("window_start string, window_end string").json(f"{root.rstrip('/')}/{SETTINGS}").first()
    except AnalysisException:
        return params
    return params.with_(window_start=found.window_start, window_end=found.window_end) if found else params


def since(fact: DataFrame, moment: Column) -> DataFrame:
    """Lines from a moment on, reading no earlier month.

    The table is partitioned by month text.  A filter on the date alone would
    read every partition, so the months it implies are asked for as well.
    """
    return fact.where((F.col(MONTH) >= year_month(moment)) & (F.col("order_date") >= moment)).drop(MONTH)


def until(fact: DataFrame, moment: Column) -> DataFrame:
    return fact.where((F.col(MONTH) <= year_month(moment)) & (F.col("order_date") <= moment)).drop(MONTH)


def read_fact(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "fact_orders").drop(MONTH)
