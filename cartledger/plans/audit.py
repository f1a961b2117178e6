"""Declared constraints, table counts and previews.

Spark tables do not enforce keys, lengths or references, so each promise of
the target schema is a query that counts the rows breaking it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.schemas import TABLES, Col, Table

PREVIEW_ROWS = (5, 50)  # fixed value: fewest and most rows of a preview


def _fits(column: Col) -> tuple[str, Column] | None:
    """Name of the type check and a condition that holds for values the type can store."""
    value = F.col(column.name)
    length = re.fullmatch(r"VARCHAR\((\d+)\)", column.type)
    if length:
        return "length", F.length(value) <= int(length[1])
    if column.type == "INT" or column.type.startswith("DECIMAL"):
        return "range", value.try_cast(column.type).isNotNull()
    return None


def column_checks(df: DataFrame, table: Table) -> DataFrame:
    """Missing values and values too large for their type, all in one pass."""
    counts = []
    for c in table.columns:
        if c.required:
            counts.append(("not_null", c.name, F.count_if(F.col(c.name).isNull())))
        fits = _fits(c)
        if fits:
            counts.append((fits[0], c.name, F.count_if(F.col(c.name).isNotNull() & ~fits[1])))
    row = df.agg(
        F.array(
            *[
                F.struct(F.lit(check).alias("check"), F.lit(name).alias("column"), n.alias("violations"))
                for check, name, n in counts
            ]
        ).alias("found")
    )
    return row.select(F.explode("found").alias("f")).select(F.lit(table.key).alias("table"), "f.*")


def _one_check(df: DataFrame, table: Table, check: str, column: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("violations")).select(
        F.lit(table.key).alias("table"), F.lit(check).alias("check"), F.lit(column).alias("column"), "violations"
    )


def _whole(table: Table, column: str) -> bool:
    return next(c.type for c in table.columns if c.name == column) == "INT"


def _present(df: DataFrame, key: str) -> DataFrame:
    """The keys of a whole-number column as bitmaps of 32,768 keys each, with the rows that have them.

    Map tasks reduce their rows to bitmaps, so no key is shuffled; there are at most
    131,072 bitmaps, whatever the number of rows.
    """
    known = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"))
    return known.groupBy(F.bitmap_bucket_number("key").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("keys"), F.count(F.lit(1)).alias("n")
    )


def key_check(df: DataFrame, table: Table) -> DataFrame:
    """Rows beyond the first of each key; a missing key is the business of not_null."""
    key = table.primary_key
    if _whole(table, key):
        return _one_check(_present(df, key), table, "primary_key", key, F.sum(F.col("n") - F.bitmap_count("keys")))
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _one_check(per_key, table, "primary_key", key, F.sum(F.col("n") - 1))


def reference_check(df: DataFrame, table: Table, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent lacks.  Keys are counted first, so the join moves keys.

    Of whole-number keys only those are looked at whose bitmap has a key that the
    parent's bitmap lacks: none, if nothing is wrong.
    """
    if _whole(table, column):
        here, there = _present(df, column), _present(parent, parent_key)
        both = here.select("part", "keys", F.lit(None).cast("binary").alias("known")).unionByName(
            there.select("part", "keys", F.col("keys").alias("known"))
        )
        every, known = (F.bitmap_count(F.bitmap_or_agg(c)) for c in ("keys", "known"))
        suspect = both.groupBy("part").agg(every.alias("every"), known.alias("known")).where("every > coalesce(known, 0)")
        part = F.bitmap_bucket_number(F.col(column).cast("long"))
        df = df.withColumn("_part", part).join(F.broadcast(suspect.select(F.col("part").alias("_part"))), "_part", "left_semi")
    per_key = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    orphans = per_key.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")
    return _one_check(orphans, table, "foreign_key", column, F.sum("n"))


def constraint_audit(table_of: Callable[[str], DataFrame]) -> DataFrame:
    """One row per declared constraint with the number of rows that break it."""
    frames = {key: table_of(key) for key in TABLES}
    checks = []
    for key, table in TABLES.items():
        checks.append(column_checks(frames[key], table))
        if table.primary_key:
            checks.append(key_check(frames[key], table))
        for column, parent in table.references.items():
            checks.append(
                reference_check(frames[key], table, column, frames[parent], TABLES[parent].primary_key)
            )
    return reduce(DataFrame.unionByName, checks)


def table_counts(table_of: Callable[[str], DataFrame | None]) -> DataFrame:
    """Rows per registered table; a table that cannot be had (None) counts as null."""
    counts = []
    for key, table in TABLES.items():
        df = table_of(key)
        if df is None:
            count = SparkSession.active().range(1).select(F.lit(None).cast("long").alias("row_count"))
        else:
            count = df.agg(F.count(F.lit(1)).alias("row_count"))
        counts.append(count.select(F.lit(table.name).alias("table_name"), F.lit(table.label).alias("label"), "row_count"))
    return reduce(DataFrame.unionByName, counts)


def catalog_table(spark: SparkSession) -> Callable[[str], DataFrame | None]:
    """Look registered tables up in the session catalog, tolerating absent ones."""

    def find(key: str) -> DataFrame | None:
        name = TABLES[key].name
        return spark.table(name) if spark.catalog.tableExists(name) else None

    return find


def if_present(table_of: Callable[[str], DataFrame]) -> Callable[[str], DataFrame | None]:
    """The same lookup, with None for a table that cannot be read."""

    def find(key: str) -> DataFrame | None:
        try:
            return table_of(key)
        except AnalysisException:
            return None

    return find


def table_preview(table_of: Callable[[str], DataFrame], key: str, rows: int = 10, ordered: bool = False) -> DataFrame:
    """Some rows of a registered table; with ``ordered`` always the same ones.

    Unordered, Spark reads no more than it needs; ordered, it reads the table.
    """
    low, high = PREVIEW_ROWS
    if key not in TABLES:
        raise ValueError(f"unknown table {key!r}")
    if not low <= rows <= high:
        raise ValueError(f"a preview has {low} to {high} rows")
    df = table_of(key).select(*TABLES[key].column_names)
    if ordered:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns])
    return df.limit(rows)
