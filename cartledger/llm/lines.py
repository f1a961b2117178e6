"""Line dedup: levelled sorted runs of line hashes.

A document's lines are reduced to the hashes of their keys (stripped, A-Z
lowered).  Documents come in batches.  A run is a written table, sorted by hash
inside its partitions, of hashes with the number of documents that hold them.
Each new batch is anti-joined (a merge join of sorted sides) with the hashes
that are already *settled*, because enough documents hold them, and adds what is
left as a run of level 0.  As soon as a level has ``fanout`` runs they are merged
into one run of the next level, and hashes that reach the limit in the merge
move to the settled runs.  The runs are the only state, so batches may arrive on
different days and after restarts.

Frequent lines then leave every document, or, with ``keep_first``, every
document but one: the one with the smallest id in the batches up to the one that
settled the line.

A hash has 96 bits.  Counts are reduced in the map tasks, so a line that a third
of all documents hold never meets in one task; text is not shuffled for
counting.

Defined results: a null or empty text is one empty line; a key without code
points is never dropped; a row is a document, so repeated rows count each; a
key is held once by a document however often it stands there; a document
without an id is never the first one, and lines that only such documents hold
stay when ``keep_first`` is set.  The result is one struct column, which
replaces a column of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.llm.native import ascii_lower, stripped, unused
from cartledger.llm.session import staged
from cartledger.staging import StageArea

HASH = ["h1", "h2"]
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    return ascii_lower(stripped(line))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The hashes seen so far, with the number of documents that hold each."""

    def __init__(self, spark, min_docs: int, fanout: int = FANOUT):
        self._stage = StageArea.of(spark)
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _write(self, counts: DataFrame, label: str) -> DataFrame:
        return self._stage.table(counts.sortWithinPartitions(*HASH), label)

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of distinct hashes with ``docs`` and ``first_doc``."""
        for run in self.settled:
            batch = batch.join(run.select(*HASH), HASH, "left_anti")
        self.levels[0].append(self._write(batch, "lines_run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = staged(_merged(self.levels[level]), "lines_merge")
        enough = F.col("docs") >= self.min_docs
        self.settled.append(self._write(merged.where(enough), "lines_settled"))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged.where(~enough), "lines_run"))
        self.levels[level] = []

    def frequent(self) -> DataFrame:
        """Hashes that enough documents hold, with the first of those documents.

        A hash that was settled early is not counted further, so ``docs`` is a
        lower bound.
        """
        open_runs = [run for level in self.levels for run in level]
        return _merged(self.settled + open_runs).where(F.col("docs") >= self.min_docs)


def _merged(runs: list[DataFrame]) -> DataFrame:
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return every.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"))


def frequent_lines(
    documents: DataFrame, min_docs: int, min_chars: int, doc_id: str, text: str, batches: int = BATCHES
) -> DataFrame:
    """Count the lines of all documents, batch by batch in the order of their ids' hash."""
    batch = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches)).cast("int")
    held = documents.select(
        batch.alias("batch"),
        F.col(doc_id).alias("doc"),
        F.explode(F.array_distinct(F.transform(_lines(F.col(text)), line_key))).alias("key"),
    ).where(F.char_length("key") >= min_chars)
    counted = (
        held.select("batch", "doc", *_hashed(F.col("key")))
        .groupBy("batch", *HASH)
        .agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first_doc"))
    )
    counted = staged(counted, "lines_counted")
    runs = LineRuns(documents.sparkSession, min_docs)
    for number in range(batches):
        runs.add(counted.where(F.col("batch") == number).drop("batch"))
    return staged(runs.frequent(), "lines_frequent")


LEFT = T.StructType(
    [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())]
)


@F.arrow_udf(LEFT)
def _without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    n_lines, n_dropped, kept = [], [], []
    for text, gone in zip(texts, dropped):
        text = text.as_py()
        lines = text.split("\n")
        n_lines.append(len(lines))
        if gone.is_valid:
            stay = np.ones(len(lines), bool)
            stay[gone.values.to_numpy()] = False
            n_dropped.append(len(lines) - int(stay.sum()))
            text = "\n".join([line for line, keep in zip(lines, stay) if keep])
        else:
            n_dropped.append(0)
        kept.append(text)
    return pa.StructArray.from_arrays(
        [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
        LEFT.names,
    )


def dedupe(
    documents: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    into: str = "lines",
) -> DataFrame:
    """Add the struct (n_lines, n_dropped, text) of what is left of each document.

    Only positions of dropped lines travel to the documents.  They are matched
    by a hash of id and text: equal rows lose equal lines.
    """
    frequent = frequent_lines(documents, min_docs, min_chars, doc_id, text)
    row = F.xxhash64(F.col(doc_id), F.col(text))
    spots = documents.select(
        row.alias("row"), F.col(doc_id).alias("doc"), F.posexplode(_lines(F.col(text))).alias("at", "line")
    ).select("row", "doc", "at", line_key(F.col("line")).alias("key"))
    spots = spots.where(F.char_length("key") >= min_chars).select("row", "doc", "at", *_hashed(F.col("key")))
    lost = spots.join(frequent, HASH)
    if keep_first:
        lost = lost.where(F.col("doc").isNull() & F.col("first_doc").isNotNull() | (F.col("doc") != F.col("first_doc")))
    lost = lost.groupBy("row").agg(F.collect_set("at").alias("dropped"))
    key, gone = unused(documents, "_row"), unused(documents, "_dropped")
    joined = documents.withColumn(key, row).join(
        lost.select(F.col("row").alias(f"{key}_lost"), F.col("dropped").alias(gone)),
        F.col(key) == F.col(f"{key}_lost"),
        "left",
    )
    kept = joined.withColumn(into, _without(F.coalesce(F.col(text), F.lit("")), F.col(gone)))
    return kept.drop(key, f"{key}_lost", gone)
