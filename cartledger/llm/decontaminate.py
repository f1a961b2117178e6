"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document when the document holds at least ``percent``
of the item's distinct word shingles.

*Sketch.*  Items fall in partitions by size.  The sketch of an item is its m
smallest shingle hashes (bottom-m MinHash), where m follows from the largest
item of its partition: a document that holds enough of an item misses at most
n - ceil(percent * n) of its n shingles, so with one more than that in the
sketch it holds one of them.  No item is missed, however long the document.
The largest hash of any sketch bounds what documents have to be searched by:
their own sketch is all their hashes up to there.

*Search.*  Documents' sketches meet the items' sketches in an equality join, whose
strategy Spark picks from the size of the written sketch table.

*Verify.*  The shingles of the documents found, as text, are counted against the
items' shingles.

Everything runs on built-in functions.

Defined results: words are the runs without white space, A-Z lowered; with fewer
words than the width the whole sequence is one shingle, so a very short item is
only found in a document that consists of it; items and documents without words
match nothing; repeated documents and items are reported once; a null id is
reported as null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartledger.llm.native import lower_words, unused
from cartledger.llm.session import staged


@dataclass(frozen=True)
class Containment:
    percent: int = 75
    width: int = 5
    broadcast_rows: int = 1_000_000  # document keys up to which documents are not shuffled


def _row(row_id: str, text: str) -> Column:
    return F.xxhash64(F.col(row_id), F.col(text))


def _worded(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return df.select(F.col(row_id).alias("id"), _row(row_id, text).alias("row"), lower_words(F.col(text)).alias("w"))


def _windows(worded: DataFrame, width: int, value: Column) -> DataFrame:
    """One row for each window; the words are a step of their own without a filter, so they are split once."""
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))))
    return worded.select("id", "row", "w", F.explode(places).alias("i")).select("id", "row", value.alias("shingle"))


def _hash(width: int) -> Column:
    return F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(width)])


def _shingle(width: int) -> Column:
    return F.array_join(F.slice("w", F.col("i") + 1, width), " ")


def _sketches(items: DataFrame, item_id: str, text: str, rule: Containment) -> DataFrame:
    """(hash, size partition) of the items' sketches."""
    hashed = _windows(_worded(items, item_id, text), rule.width, _hash(rule.width)).select("row", "shingle").distinct()
    # Bounded by the shingles of one item.
    per_item = Window.partitionBy("row")
    placed = hashed.select(
        "shingle",
        F.row_number().over(per_item.orderBy("shingle")).alias("place"),
        F.floor(F.log2(F.count(F.lit(1)).over(per_item))).cast("int").alias("part"),
    )
    largest = F.pow(F.lit(2), F.col("part") + 1).cast("long") - 1
    missed = F.floor(largest * (100 - rule.percent) / 100)
    return placed.where(F.col("place") <= missed + 1).select(F.col("shingle").alias("hash"), "part").distinct()


def _picked(df: DataFrame, key: str, keys: DataFrame, rule: Containment, how: str) -> DataFrame:
    """Join with a written table of keys, broadcast only if counted to be small."""
    if keys.count() <= rule.broadcast_rows:
        keys = F.broadcast(keys)
    return df.join(keys, key, how)


def contained(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    rule: Containment = Containment(),
) -> DataFrame:
    """(doc_id, row, item_id, n_item, n_shared, containment) of every item found in a document.

    ``row`` is a hash of the document's id and text.
    """
    sketches = staged(_sketches(items, item_id, item_text, rule), "leaks_sketch")
    top = sketches.agg(F.max("hash")).first()[0]
    searched = _windows(_worded(documents, doc_id, text), rule.width, _hash(rule.width))
    if top is not None:
        searched = searched.where(F.col("shingle") <= top)
    hits = searched.join(sketches.select(F.col("hash").alias("shingle")).distinct(), "shingle")
    keys = staged(hits.select("row").distinct(), "leaks_found")

    known = _windows(_worded(items, item_id, item_text), rule.width, _shingle(rule.width)).distinct()
    known = known.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "shingle")
    known = staged(known, "leaks_items")
    sizes = known.groupBy("item_row").agg(F.count(F.lit(1)).alias("n_item"))
    suspects = _picked(documents.select(F.col(doc_id), F.col(text), _row(doc_id, text).alias("_key")), "_key", keys.withColumnRenamed("row", "_key"), rule, "left_semi")
    held = _windows(_worded(suspects, doc_id, text), rule.width, _shingle(rule.width)).distinct()
    shared = held.join(known, "shingle").groupBy(F.col("id").alias("doc_id"), "row", "item_id", "item_row")
    shared = shared.agg(F.count(F.lit(1)).alias("n_shared")).join(sizes, "item_row")
    found = shared.where(100 * F.col("n_shared") >= rule.percent * F.col("n_item"))
    return found.select(
        "doc_id", "row", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def decontaminated(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    rule: Containment = Containment(),
) -> DataFrame:
    """The documents that contain no item, with their columns as they were."""
    key = unused(documents, "_row")
    flagged = contained(documents, items, doc_id, item_id, text, item_text, rule).select(F.col("row").alias(key)).distinct()
    keyed = documents.withColumn(key, _row(doc_id, text))
    return _picked(keyed, key, staged(flagged, "leaks_rows"), rule, "left_anti").drop(key)
