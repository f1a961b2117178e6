"""The target tables as tables of the session catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.operators.ranking import surrogate_key
from cartledger.schemas import TABLES, Table, conform
from cartledger.staging import StageArea
from cartledger.warehouse import Warehouse


def create_table_sql(table: Table) -> str:
    key = f"{table.surrogate_key} BIGINT NOT NULL, " if table.surrogate_key else ""
    return f"CREATE TABLE {table.name} ({key}{table.ddl_columns()}) USING parquet"


def create_tables(spark: SparkSession) -> None:
    """Drop and create the six tables and the schema of the analytic ones."""
    spark.sql("CREATE DATABASE IF NOT EXISTS analytics")
    for table in reversed(TABLES.values()):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    for table in TABLES.values():
        spark.sql(create_table_sql(table))


def truncate_tables(spark: SparkSession) -> None:
    for table in reversed(TABLES.values()):
        spark.sql(f"TRUNCATE TABLE {table.name}")


def with_keys(df: DataFrame, table: Table, stage: StageArea) -> DataFrame:
    """Declared columns and types, numbered 1..n in the order of all columns."""
    stored = conform(df, table)
    if table.surrogate_key is None:
        return stored
    order = [F.col(c).asc_nulls_last() for c in stored.columns]
    keyed = surrogate_key(stage.table(stored, table.key), table.surrogate_key, order, stage)
    return keyed.select(table.surrogate_key, *stored.columns)


def load_tables(w: Warehouse) -> None:
    """Replace the content of every table; parents come before their children."""
    w = w.settle()
    for key, table in TABLES.items():
        with_keys(w.table(key), table, w.stage).write.insertInto(table.name, overwrite=True)
