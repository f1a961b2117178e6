"""Token counts by separator scan over flat token files.

A flat token file is nothing but token ids as little-endian unsigned integers,
each document followed by the end-of-document id; there is no index.  The scan
cuts every file into blocks, looks for that id in each block with one
vectorised comparison, and stitches the documents that reach over block borders
with a prefix scan over one small row per block: tokens before the block,
documents ended before it, and where the last one ended.

Files are read whole by Spark's binary source, which takes files of up to 2 GB;
:func:`write_token_files` keeps its files far below that, and the scan holds one
file and one block at a time.

Defined results: a null text is an empty document of no tokens; tokens after the
last separator are a document that is marked as not terminated; an empty file
has no document; a file that is no whole number of tokens is an error; repeated
rows are documents of their own.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK_BYTES = 1 << 20
DOCUMENTS_PER_FILE = 4_000


@lru_cache(maxsize=2)
def _tokenizer(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _tokens(encoding, text: str) -> np.ndarray:
    """Ids of the whole text, however long its runs are."""
    try:
        return encoding.encode_to_numpy(text)
    except ValueError:  # the library's matcher has no room for about a million blanks in a row
        found = regex.finditer(encoding._pat_str, text)
        return np.array([token for piece in found for token in encoding._encode_single_piece(piece.group())], np.uint32)


def write_token_files(
    documents: DataFrame, folder: str, ranks: str, pattern: str, separator: int, text: str = "text", width: int = 2
) -> None:
    """Write the documents' ids under a public rank file as flat token files.

    Spark's text writer puts out the bytes of each row and a line separator; here
    the rows are ids and the separator is the end-of-document id.
    """
    with open(ranks, "rb") as file:
        shipped = documents.sparkSession.sparkContext.broadcast(file.read())  # one file of fixed size

    @F.arrow_udf(T.BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        encoding = _tokenizer(shipped.value, pattern)
        return pa.array([_tokens(encoding, t).astype(f"<u{width}").tobytes() for t in texts.to_pylist()], pa.binary())

    (
        documents.select(ids(F.coalesce(F.col(text), F.lit(""))).cast("string").alias("value"))
        .write.option("lineSep", separator.to_bytes(width, "little").decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", DOCUMENTS_PER_FILE)
        .text(folder)
    )


SUMMARY = T.StructType(
    [*[T.StructField(c, T.LongType()) for c in ("n_tokens", "first_end", "last_end")], T.StructField("inner", T.ArrayType(T.LongType()))]
)


def _summaries(separator: int, width: int):
    @F.arrow_udf(SUMMARY)
    def summary(blocks: pa.Array) -> pa.Array:
        sizes, firsts, lasts, inner = [], [], [], []
        for block in blocks:
            tokens = np.frombuffer(block.as_buffer(), f"<u{width}")
            ends = np.flatnonzero(tokens == separator)
            sizes.append(len(tokens))
            firsts.append(int(ends[0]) if len(ends) else None)
            lasts.append(int(ends[-1]) + 1 if len(ends) else None)
            inner.append(np.diff(ends) - 1 if len(ends) > 1 else np.zeros(0, np.int64))
        columns = [pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(inner, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, SUMMARY.names)

    return summary


def scan(spark: SparkSession, folder: str, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, doc_no, n_tokens, terminated) of every document of the token files in the folder."""
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    broken = F.raise_error(F.concat(F.lit("no whole number of tokens: "), F.col("path")))
    starts = F.when(F.col("length") % width == 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long")))
    blocks = files.select("path", "content", F.posexplode(F.coalesce(starts, broken.cast("array<bigint>"))).alias("block", "at"))
    blocks = blocks.select("path", "block", F.substring("content", (F.col("at") + 1).cast("int"), F.lit(block_bytes)).alias("bytes"))
    found = blocks.select("path", "block", _summaries(separator, width)(F.col("bytes")).alias("s")).select("path", "block", "s.*")

    # One row per block: at most 2 GB / block_bytes rows of a file meet.
    per_file = Window.partitionBy("path").orderBy("block")
    before = per_file.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.when(F.col("first_end").isNull(), 0).otherwise(F.size("inner") + 1)
    placed = found.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = placed.withColumn("base", F.coalesce(F.sum(ended).over(before), F.lit(0)))
    placed = placed.withColumn("open_from", F.coalesce(F.max(F.col("start") + F.col("last_end")).over(before), F.lit(0)))
    placed = placed.withColumn("is_last", F.lead("block").over(per_file).isNull())

    first = F.array(F.col("start") + F.col("first_end") - F.col("open_from"))
    whole = F.when(F.col("first_end").isNull(), F.array().cast("array<bigint>")).otherwise(F.concat(first, F.col("inner")))
    reached = F.coalesce(F.col("start") + F.col("last_end"), F.col("open_from"))
    rest = F.when(F.col("is_last"), F.col("start") + F.col("n_tokens") - reached).otherwise(F.lit(0))
    tail = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    listed = placed.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "base", F.size(whole).alias("n_whole"), F.posexplode(F.concat(whole, tail)).alias("i", "n_tokens"))
    return listed.select("file", (F.col("base") + F.col("i")).alias("doc_no"), "n_tokens", (F.col("i") < F.col("n_whole")).alias("terminated"))
