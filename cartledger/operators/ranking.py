"""Orderings over a whole table that do not meet in one task.

``Window.orderBy`` without a partition moves every row to one task.  Here the
rows are range-partitioned by the ordering, sorted inside each partition, and
numbered by partition offset plus position, whatever their number.

The frames that come in are expected to be cheap to read twice (a staged or
stored table), because range partitioning samples its input first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartledger.staging import StageArea

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, position below


def row_index(df: DataFrame, order: Sequence[Column], stage: StageArea, name: str = "row_index") -> DataFrame:
    """Add the 0-based position in the given order, which must leave no ties.

    Range bounds are sampled, so the numbered rows are written once and every
    later reader sees the same partitions.
    """
    number = F.monotonically_increasing_id()
    numbered = stage.table(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(number, _POSITION_BITS))
        .withColumn("_pos", number.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))),
        name,
    )
    # One row per range partition: as many as there were tasks, not as there is data.
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def surrogate_key(df: DataFrame, name: str, order: Sequence[Column], stage: StageArea) -> DataFrame:
    """Add a dense key 1..n that follows the given order."""
    return row_index(df, order, stage, name).withColumn(name, F.col(name) + 1)


def dense_rank(
    df: DataFrame,
    value: str,
    name: str,
    stage: StageArea,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add the dense rank of ``value``, largest first, optionally within groups.

    ``df`` is a staged table.  The distinct values are numbered instead of the
    rows, so neither one big group nor one very common value ends up in one task.
    """
    largest_first = F.col(value).desc_nulls_last()
    groups = [F.col(c).asc_nulls_first() for c in within]
    values = stage.table(df.select(*within, value).distinct(), f"{name}_values")
    indexed = row_index(values, [*groups, largest_first], stage, "_index")
    if within:
        first = indexed.groupBy(*within).agg(F.min("_index").alias("_first"))
        pairs = [(c, f"_g{i}") for i, c in enumerate(within)]
        for c, g in pairs:
            first = first.withColumnRenamed(c, g)
        matches = [F.col(c).eqNullSafe(F.col(g)) for c, g in pairs]
        indexed = indexed.join(first, matches).drop(*[g for _, g in pairs])
    else:
        indexed = indexed.withColumn("_first", F.lit(0))
    ranks = indexed.select(
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate([*within, value])],
        (F.col("_index") - F.col("_first") + 1).cast("int").alias(name),
    )
    on = [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate([*within, value])]
    return df.join(ranks, on).drop(*[f"_r{i}" for i in range(len(within) + 1)])
