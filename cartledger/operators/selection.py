"""Tiles of equal size without sorting: only the rows at the tiles' borders are looked for.

Each border is a rank in the order (value, tie).  It is known to lie in an
interval of values, at first from the smallest to the largest; a round counts the
rows of every interval in ``BUCKETS`` equal steps, all metrics and borders in one
pass, and narrows each interval to the step that holds its rank.  When an interval
has shrunk to one value it goes on along the tie.  As soon as few rows are left in
all of them these are fetched and the borders read off.

Counts are reduced in the map tasks, so a round moves some thousand numbers per
task, however many rows there are and however often one value occurs, and the
rounds are few: a thousandfold narrowing each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024
FEW = 2048  # rows of an interval that are fetched


@dataclass(frozen=True)
class _Axis:
    """A column as whole steps: days of a date, units of the last digit of a decimal, or the number itself."""

    column: str
    type: T.DataType

    @property
    def _scale(self) -> int:
        return self.type.scale if isinstance(self.type, T.DecimalType) else 0

    @property
    def value(self) -> Column:
        c = F.col(self.column)
        return F.unix_date(c).cast("long") if isinstance(self.type, T.DateType) else c if self._scale or isinstance(self.type, T.DecimalType) else c.cast("long")

    def literal(self, steps: int) -> Column:
        if isinstance(self.type, T.DecimalType):
            return F.lit(str(Decimal(steps).scaleb(-self._scale))).cast(T.DecimalType(38, self._scale))
        return F.lit(steps).cast("long")

    def steps(self, value) -> int:
        return int(Decimal(value).scaleb(self._scale)) if value is not None else 0


@dataclass(frozen=True)
class _Interval:
    """Steps from ``low`` to ``high`` of one metric and, within a single value, of the tie."""

    metric: int
    low: int
    high: int
    tie_low: int
    tie_high: int
    rows: int

    @property
    def along_tie(self) -> bool:
        return self.low == self.high

    @property
    def width(self) -> int:
        low, high = (self.tie_low, self.tie_high) if self.along_tie else (self.low, self.high)
        return -(-(high - low + 1) // BUCKETS)

    def bucket(self, number: int) -> "_Interval":
        if self.along_tie:
            low = self.tie_low + number * self.width
            return replace(self, tie_low=low, tie_high=min(self.tie_high, low + self.width - 1))
        low = self.low + number * self.width
        return replace(self, low=low, high=min(self.high, low + self.width - 1))


class _Search:
    def __init__(self, df: DataFrame, metrics: Sequence[str], tie: str):
        self.df = df
        self.axes = [_Axis(m, df.schema[m].dataType) for m in metrics]
        self.tie = _Axis(tie, df.schema[tie].dataType)
        ends = [f(a.value) for a in [*self.axes, self.tie] for f in (F.min, F.max)]
        self.rows, *found = df.agg(F.count(F.lit(1)), *ends).first()
        low_high = [(a.steps(low), a.steps(high)) for a, low, high in zip([*self.axes, self.tie], found[::2], found[1::2])]
        # A missing value comes before all others.
        self.values = [F.coalesce(a.value, a.literal(low - 1)) for a, (low, _) in zip(self.axes, low_high)]
        *ends, (tie_low, tie_high) = low_high
        self.whole = [_Interval(i, low - 1, high, tie_low, tie_high, self.rows) for i, (low, high) in enumerate(ends)]

    def holds(self, i: _Interval) -> Column:
        axis, value = self.axes[i.metric], self.values[i.metric]
        inside = (value >= axis.literal(i.low)) & (value <= axis.literal(i.high))
        return inside & self.tie.value.between(i.tie_low, i.tie_high) if i.along_tie else inside

    def counted(self, intervals: list[_Interval]) -> dict[tuple[int, int], int]:
        """(interval, bucket) -> rows."""
        found = []
        for number, i in enumerate(intervals):
            axis, value, low = (self.tie, self.tie.value, i.tie_low) if i.along_tie else (self.axes[i.metric], self.values[i.metric], i.low)
            steps = F.call_function("div", value - axis.literal(low), axis.literal(i.width)).cast("int")
            found.append(F.when(self.holds(i), F.struct(F.lit(number).alias("interval"), steps.alias("bucket"))))
        hits = self.df.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("hit"))
        return {(r[0], r[1]): r[2] for r in hits.groupBy("hit.interval", "hit.bucket").count().collect()}

    def narrowed(self, wanted: list[tuple[_Interval, int]]) -> list[tuple[_Interval, int]]:
        """One round: (interval, rank in it) of each border."""
        large = sorted({i for i, _ in wanted if i.rows > FEW}, key=str)
        counts = self.counted(large)
        out = []
        for interval, rank in wanted:
            if interval in large:
                number = large.index(interval)
                for bucket in sorted(b for n, b in counts if n == number):
                    rows = counts[number, bucket]
                    if rank < rows:
                        interval = replace(interval.bucket(bucket), rows=rows)
                        break
                    rank -= rows
            out.append((interval, rank))
        return out

    def fetched(self, wanted: list[tuple[_Interval, int]]) -> list[tuple[int, int, int]]:
        """(metric, value, tie) of each border, all in few-row intervals."""
        intervals = sorted({i for i, _ in wanted}, key=str)
        found = [F.when(self.holds(i), F.struct(F.lit(n).alias("n"), self.values[i.metric].cast("string").alias("v"))) for n, i in enumerate(intervals)]
        hits = self.df.select(self.tie.value.alias("tie"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("hit"))
        rows: dict[int, list[tuple[int, int]]] = {n: [] for n in range(len(intervals))}
        for tie, (n, v) in hits.collect():
            rows[n].append((self.axes[intervals[n].metric].steps(v), tie))
        return [(i.metric, *sorted(rows[intervals.index(i)])[rank]) for i, rank in wanted]

    def after(self, border: tuple[int, int, int]) -> Column:
        metric, value, tie = border
        own, at = self.values[metric], self.axes[metric].literal(value)
        return (own > at) | ((own == at) & (self.tie.value > self.tie.literal(tie)))


def tiles(df: DataFrame, count: int, metrics: dict[str, str], tie: str) -> DataFrame:
    """Add a tile number per entry of ``metrics``: name -> column, ascending, equal values by ``tie``.

    Tiles are those of ``ntile``: sizes differ by at most one, larger ones first.
    ``df`` is a staged table, read a few times; a metric is a date, a whole number
    or a decimal, and ``tie`` a whole number, without nulls and different in every row.
    """
    search = _Search(df, list(metrics.values()), tie)
    small, extra = divmod(search.rows, count)
    # The last row of each tile but the final one; a row's tile is one more than
    # the number of those that lie before it.
    ranks = sorted({t * small + min(t, extra) - 1 for t in range(1, count)} - {-1})
    wanted = [(interval, rank) for interval in search.whole for rank in ranks]
    while any(i.rows > FEW for i, _ in wanted):
        wanted = search.narrowed(wanted)
    borders = search.fetched(wanted) if wanted else []
    for number, name in enumerate(metrics):
        passed = [search.after(b).cast("int") for b in borders if b[0] == number]
        df = df.withColumn(name, sum(passed, F.lit(1)))
    return df
