"""The training-data pipeline: five stages from documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.llm import bpe, decontaminate, jaccard, lines, quality
from cartledger.llm.native import unused
from cartledger.llm.pieces import SMALL_PIECE
from cartledger.llm.session import ready, staged, table


BATCH_BYTES = 2 << 20  # of texts at a time: workers hold a multiple of it, and stay from stage to stage


def _lean(spark: SparkSession) -> None:
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _retexted(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of documents with another text and its length."""
    docs = docs.withColumn("text", text)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line rules clean the text; documents that they reject go."""
    _lean(spark)
    return _retexted(quality.cleaned(docs), docs.columns, F.col("text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of ten documents or more stays in one of them; a document left without a word goes."""
    _lean(spark)
    columns, into = docs.columns, unused(docs, "lines")
    left = lines.dedupe(docs, keep_first=True, into=into)
    emptied = (F.col(f"{into}.n_dropped") > 0) & ~F.col(f"{into}.text").rlike("[^\\x20\\x09-\\x0D]")
    return _retexted(left.where(~emptied), columns, F.col(f"{into}.text"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    _lean(spark)
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in the layout of token files."""
    _lean(spark)
    into = unused(docs, "tokens")
    # The workers have four stages behind them: small pieces, and fewer chunks remembered.
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.with_ids(docs, vocabulary, into=into, piece_bytes=SMALL_PIECE, cached=60_000)
    return encoded.select("doc_id", "lang", "source", F.col(f"{into}.n_tokens").alias("n_tokens"), F.col(f"{into}.ids").alias("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Token ids and near-duplicate classes are not expressible in SQL; tests hold
# the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
