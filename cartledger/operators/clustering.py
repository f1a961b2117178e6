"""Rows laid out so that the statistics of row groups prune by several columns at once.

Each column is cut at its quantiles into 2**bits steps, and the steps' bits are
interleaved (Z-order): rows close in the key are close in every column, so a row
group sorted by it covers a small range of each.  The quantiles come from a bounded
sample, the ``SAMPLE`` rows with the smallest hashes; they decide about the layout
only, never about rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6  # per column
SAMPLE = 20_000


def quantiles(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list]:
    """Per column the values at which its steps begin, ascending; a missing value lies before all."""
    picked = df.select(*columns).orderBy(F.xxhash64(*df.columns)).limit(SAMPLE).collect()
    cuts = {}
    for c in columns:
        values = sorted(r[c] for r in picked if r[c] is not None)
        places = [len(values) * i >> bits for i in range(1, 1 << bits)] if values else []
        cuts[c] = sorted({values[p] for p in places})
    return cuts


def step(column: Column, cuts: list) -> Column:
    """How many of the cuts are not above the value, by binary decisions."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(cuts[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return F.coalesce(F.when(column.isNotNull(), between(0, len(cuts))), F.lit(0))


def z_key(cuts: dict[str, list], bits: int = BITS) -> Column:
    """The columns' steps with their bits interleaved."""
    steps = [step(F.col(c), values) for c, values in cuts.items()]
    key = F.lit(0)
    for bit in range(bits):
        for place, s in enumerate(steps):
            key = key + F.shiftleft(F.shiftright(s, bit).bitwiseAND(F.lit(1)), bit * len(steps) + place)
    return key


def clustered(df: DataFrame, first: str, columns: Sequence[str], bits: int = BITS) -> DataFrame:
    """Rows in ranges of (``first``, key), sorted in each; the key is not kept."""
    key = "_key"
    keyed = df.withColumn(key, z_key(quantiles(df, columns, bits), bits))
    return keyed.repartitionByRange(first, key).sortWithinPartitions(first, key).drop(key)
