"""Joins of many rows with a table of one row per key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartledger.llm.native import unused

BROADCAST_ROWS = 1_000_000
SALTS = 64


def attached(rows: DataFrame, table: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the other columns of ``table``, which is staged and has each key (null is one) once.

    The table is counted first.  Beyond the bound, rows are dealt by key and a
    salt, and the table comes once per salt, so that a hot key meets in many tasks.
    """
    name, salt = unused(rows, "_key"), unused(rows, "_salt")
    other = table.withColumnRenamed(key, name)
    same = F.col(key).eqNullSafe(F.col(name))
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(other), same, "left").drop(name)
    salted = rows.withColumn(salt, (F.rand(0) * SALTS).cast("int"))
    other = other.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(other, same & (F.col(salt) == F.col(f"{salt}_")), "left").drop(name, salt, f"{salt}_")
