"""The curated zone: one Parquet folder per table, the fact table by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartledger.functions.dates import year_month
from cartledger.operators import clustering
from cartledger.schemas import TABLES
from cartledger.sources.curated import FOLDERS, MONTH
from cartledger.staging import CODEC


CLUSTERED = ["customer_id", "product_id"]


def write_parquet(
    df: DataFrame, uri: str, month_of: str | None = None, clustered: Sequence[str] = (), row_group_bytes: int | None = None
) -> None:
    """Replace the folder.  ``month_of`` names the time column to partition by.

    Rows of one month are brought together to keep files few, by a rebalance
    rather than a repartition: adaptive execution splits a month that is larger
    than one task should write.  With ``clustered`` rows of a month are laid out by
    these columns at once, so that a reader looking for one value of either skips
    most row groups.
    """
    writer_of = df
    if month_of is not None:
        writer_of = df.withColumn(MONTH, year_month(F.col(month_of)))
        writer_of = clustering.clustered(writer_of, MONTH, clustered) if clustered else writer_of.hint("rebalance", F.col(MONTH))
    writer = writer_of.write.mode("overwrite").options(partitionOverwriteMode="static", compression=CODEC)
    if month_of is not None:
        writer = writer.partitionBy(MONTH)
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(uri)


def write_table(df: DataFrame, root: str, key: str, clustered: bool = False) -> None:
    """``clustered`` lays the fact table out by customer and product; it reads a staged or stored frame twice."""
    table = TABLES[key]
    month_of = "order_date" if key == "fact_orders" else None
    by = CLUSTERED if clustered and month_of else ()
    write_parquet(df.select(*table.column_names), f"{root.rstrip('/')}/{FOLDERS[key]}", month_of, by)
