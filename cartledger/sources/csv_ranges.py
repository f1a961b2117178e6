"""Large CSV files in many tasks, quoted line breaks and all.

Spark splits a CSV file only if no field may hold a line break, as a range of
bytes does not show whether it begins inside quotes.  Here the file is scanned as
text, which is split, and that one bit is found out by a prefix scan:

1. Each range goes through its lines under both assumptions.  What it does to the
   bit is one of four functions (keep, flip, set, clear).
2. A window over the ranges of a file, in order, composes them: the last set or
   clear before a range and the flips since then tell how the range begins.
3. Each range cuts its lines into records.  A record that goes on in another range
   is given out in pieces, at most one at either end of a range, which are put
   together by the range in which the record begins.
4. ``from_csv`` parses records under the options of :mod:`csv_files`.

A quote opens a field only at its beginning, and one inside is doubled; after the
closing quote a field ends at the next separator.  Lines end with a line feed, with
or without a carriage return before it.  The first record of each file is its
header; empty lines are no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartledger.schemas import CORRUPT
from cartledger.sources.csv_files import READ_SCHEMA, csv_options, to_lines
from cartledger.staging import StageArea

BROADCAST_RANGES = 1_000_000  # ranges that begin inside quotes, up to which lines are not shuffled

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
RANGE = ["file", "start"]
COMPLETE, OPENED, CONTINUED = 0, 1, 2


def open_after(line: str, is_open: bool) -> bool:
    """Whether a quoted field is open behind the line, given whether one is before it."""
    at = 0
    while True:
        if is_open:
            at = _QUOTED.match(line, at).end()
            if at >= len(line):
                return True
            at = line.find(",", at + 1) + 1
            if not at:
                return False
        elif line[at : at + 1] != '"':
            at = line.find(',"', at) + 1
            if not at:
                return False
        is_open = line[at : at + 1] == '"'
        at += is_open


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batches cut where the range changes; a task's ranges come one after the other, lines in order."""
    for batch in batches:
        keys = np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(keys)]):
            if end > begin:
                yield (int(keys[begin, 0]), int(keys[begin, 1])), batch.slice(begin, end - begin)


QUOTE, COMMA, RETURN = 34, 44, 13
_SLOW_LINES = 256  # lines looked at one by one where quotes are not as writers put them


def _by_alternation(lines: pa.Array, is_open: bool) -> tuple[np.ndarray, int]:
    """Open or not before each line and behind the last, if quotes open and close in turn; and up to which line they do.

    They do as long as each opening quote begins a field or follows a closing one
    (a doubled quote), and each closing one ends a field or precedes an opening one.
    """
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    body = lines.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    data = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(2, np.uint8)])
    offsets = offsets - offsets[0]
    spots = np.flatnonzero(data == QUOTE)
    line = np.searchsorted(offsets, spots, "right") - 1
    opens = (np.arange(len(spots)) + is_open) % 2 == 0
    previous, following = data[spots - 1], data[spots + 1]
    at_end = (spots + 1 == offsets[line + 1]) | ((spots + 2 == offsets[line + 1]) & (following == RETURN))
    begins = (spots == offsets[line]) | (previous == COMMA) | (previous == QUOTE)
    ends = at_end | (following == COMMA) | (following == QUOTE)
    odd = np.flatnonzero(~np.where(opens, begins, ends))
    good = int(line[odd[0]]) if len(odd) else len(lines)
    before = (np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(lines)))]) + is_open) % 2 == 1
    return before[: good + 1], good


def open_before(lines: pa.Array, is_open: bool) -> np.ndarray:
    """Whether a quoted field is open before each line, and behind the last."""
    out, at = np.zeros(len(lines) + 1, bool), 0
    while True:
        before, good = _by_alternation(lines.slice(at), is_open)
        out[at : at + good + 1] = before
        at, is_open = at + good, bool(before[-1])
        if at == len(lines):
            return out
        for _ in range(min(_SLOW_LINES, len(lines) - at)):
            is_open = open_after(lines[at].as_py(), is_open)
            at += 1
            out[at] = is_open


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range whether a field is open behind it, for either state before it.

    As a rule the two agree after a few lines with quotes.
    """
    key, ends, out = None, [False, True], []
    for own, run in _runs(batches):
        if own != key:
            if key is not None:
                out.append((*key, *ends))
            key, ends = own, [False, True]
        lines, at = run.column(0), 0
        if ends[0] != ends[1]:
            for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
                line = lines[i].as_py()
                ends, at = [open_after(line, e) for e in ends], int(i) + 1
                if ends[0] == ends[1]:
                    break
        if ends[0] == ends[1]:
            ends = [bool(open_before(lines.slice(at), ends[0])[-1])] * 2
    if key is not None:
        out.append((*key, *ends))
    columns = list(zip(*out)) or [[]] * 4
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*RANGE, "if_closed", "if_open"])


class _Cutter:
    """Cuts the lines of one range into records."""

    def __init__(self, key: tuple[int, int], begins_open: bool):
        self.key, self.is_open = key, begins_open
        self.header = key[1] == 0  # the file's first record is still to come
        self.parts: list[str] = []  # of a record that is not complete yet
        self.kind = CONTINUED if begins_open else OPENED

    def cut(self, lines: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        before = open_before(lines, self.is_open)
        self.is_open = bool(before[-1])
        begins = np.flatnonzero(~before)  # with the end of the lines, if a record ends there
        first = int(begins[0]) if len(begins) else len(lines)
        self.parts += lines.slice(0, first).to_pylist()
        if self.parts and len(begins):
            yield from self._ended()
        if not len(begins):
            return
        last = int(begins[-1])
        if self.header and len(begins) > 1:
            self.header, begins = False, begins[1:]
        if len(begins) > 1:
            yield COMPLETE, pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), lines), "\n")
        self.parts = lines.slice(last).to_pylist()

    def _ended(self) -> Iterator[tuple[int, pa.Array]]:
        kind = self.kind if self.kind == CONTINUED else COMPLETE
        if self.header and kind == COMPLETE:
            self.header = False
        else:
            yield kind, pa.array(["\n".join(self.parts)])
        self.parts, self.kind = [], OPENED

    def close(self) -> Iterator[tuple[int, pa.Array]]:
        """What is still open at the end of the range."""
        if self.parts:
            kind = -1 if self.header and self.kind == OPENED else self.kind
            yield kind, pa.array(["\n".join(self.parts)])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, kind, text) of records and of pieces of records; the kind of a header's piece is -1."""

    def rows(cutter: _Cutter, found: Iterator[tuple[int, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for kind, texts in found:
            n = len(texts)
            if n:
                columns = [pa.array(np.full(n, k)) for k in cutter.key] + [pa.array(np.full(n, kind, np.int32)), texts]
                yield pa.RecordBatch.from_arrays(columns, [*RANGE, "kind", "text"])

    cutter = None
    for own, run in _runs(batches):
        if cutter is None or own != cutter.key:
            if cutter is not None:
                yield from rows(cutter, cutter.close())
            cutter = _Cutter(own, bool(run.column(3)[0].as_py()))
        yield from rows(cutter, cutter.cut(run.column(0)))
    if cutter is not None:
        yield from rows(cutter, cutter.close())


def file_key(path: Column) -> Column:
    """A number for a file's path."""
    return F.xxhash64(path)


def _scanned(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        "value", file_key(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, begins_open) of every range that holds the beginning of a line."""
    effects = _scanned(spark, path).mapInArrow(_effects, "file long, start long, if_closed boolean, if_open boolean")
    settled = F.when(F.col("if_closed") == F.col("if_open"), F.col("if_open"))
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum(F.when(F.col("if_closed") & ~F.col("if_open"), 1).otherwise(0))
    steps = effects.select(*RANGE, settled.alias("settled"), flips.over(so_far).alias("flips"))
    known = F.last(F.when(F.col("settled").isNotNull(), F.struct("settled", "flips")), ignorenulls=True).over(earlier)
    placed = steps.select(*RANGE, known.alias("known"), F.coalesce(F.lag("flips").over(Window.partitionBy("file").orderBy("start")), F.lit(0)).alias("flips"))
    odd = (F.col("flips") - F.coalesce("known.flips", F.lit(0))) % 2 == 1
    return placed.select(*RANGE, (F.coalesce("known.settled", F.lit(False)) != odd).alias("begins_open"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text) of every record of the files but their headers; ``file`` is :func:`file_key`."""
    scanned = _scanned(spark, path)
    opened = StageArea.of(spark).table(ranges(spark, path).where("begins_open"), "csv_ranges")
    if opened.count() <= BROADCAST_RANGES:
        marked = scanned.join(F.broadcast(opened), RANGE, "left")
    else:
        dealt = scanned.withColumn("line", F.monotonically_increasing_id()).join(opened, RANGE, "left")
        marked = dealt.repartition(*RANGE).sortWithinPartitions(*RANGE, "line")
    marked = marked.select("value", *RANGE, F.coalesce("begins_open", F.lit(False)).alias("begins_open"))
    cut = marked.mapInArrow(_records, "file long, start long, kind int, text string")
    pieces = cut.where(F.col("kind") != COMPLETE)
    # A range ends with the piece it opens, and begins with the one it continues.
    order = Window.partitionBy("file").orderBy("start", F.col("kind").desc())
    beginning = F.last(F.when(F.col("kind") != CONTINUED, F.col("start")), ignorenulls=True).over(order)
    whole = (
        pieces.select("file", "start", "kind", "text", beginning.alias("begins"))
        .groupBy("file", "begins")
        .agg(F.min("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
        .where("kind >= 0")
        .select("file", F.array_join(F.transform("parts", lambda p: p.text), "\n").alias("text"))
    )
    text = F.regexp_replace("text", "\r$", "").alias("text")
    return cut.where(F.col("kind") == COMPLETE).select("file", "text").unionByName(whole).select("file", text).where("text != ''")


def read_raw(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """The same rows and columns as :func:`csv_files.read_raw`, each file in as many tasks as it has ranges.

    With ``with_file`` also the :func:`file_key` of a row's file, as ``file``.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in READ_SCHEMA.fields)
    options = {k: v for k, v in csv_options().items() if k != "header"}
    rows = records(spark, path).select("file", F.from_csv("text", schema, options).alias("row"))
    return rows.select(*(["file"] if with_file else []), "row.*")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return to_lines(read_raw(spark, path)).drop(CORRUPT)
