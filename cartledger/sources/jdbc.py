"""Reading a table of a relational store, in parallel when a key range is given."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Store:
    """Where the relational store is and how to speak to it."""

    url: str
    user: str
    password: str = field(repr=False)
    driver: str = "org.postgresql.Driver"
    connections: int = 8
    batch_rows: int = 10_000
    fetch_rows: int = 10_000

    def options(self, table: str) -> dict[str, str]:
        return {
            "url": self.url,
            "dbtable": table,
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
            "numPartitions": str(self.connections),
        }


@dataclass(frozen=True)
class KeyRange:
    """A numeric, date or timestamp column and the span its values lie in.

    Values outside the span are still read, by the first and last task.
    """

    column: str
    lower: str
    upper: str


def read_options(store: Store, table: str, split: KeyRange | None = None) -> dict[str, str]:
    options = {**store.options(table), "fetchsize": str(store.fetch_rows)}
    if split is not None:
        options |= {"partitionColumn": split.column, "lowerBound": split.lower, "upperBound": split.upper}
    return options


def count_options(store: Store, table: str) -> dict[str, str]:
    """Options under which the store itself counts the rows."""
    options = {k: v for k, v in store.options(table).items() if k not in ("dbtable", "numPartitions")}
    return {**options, "query": f"SELECT count(*) AS n FROM {table}"}


def count_rows(spark: SparkSession, store: Store, table: str) -> int:
    return int(spark.read.format("jdbc").options(**count_options(store, table)).load().first()[0])


def read_table(spark: SparkSession, store: Store, table: str, split: KeyRange | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(store, table, split)).load()
