"""The operators bound to the given tables, and as SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cartledger.llm import binary, bpe, chat, codes, decontaminate, jaccard, langid, licenses, lines, lm, merkle, quality, sql, token_counts
from cartledger.llm.native import ascii_lower
from cartledger.llm.session import table
from cartledger.staging import StageArea


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.contained(documents, table(spark, folder, "benchmark")).drop("row")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    tokens = F.col("tokens")
    return bpe.with_ids(documents, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        tokens.n_tokens.alias("n_tokens"),
        F.sha2(tokens.ids, 256).alias("ids_sha256"),
        F.sha2(tokens.decoded, 256).alias("decoded_sha256"),
    )


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.remainder("doc_id", 5) == 1, F.lit(False))
    return lm.score(documents, held_out, public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    files = StageArea.of(spark).path("token_files")
    separator = 50256  # the end-of-document id of the vocabulary
    token_counts.write_token_files(
        documents, files, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, separator
    )
    return token_counts.scan(spark, files, separator)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False))
    training = documents.where(~held_out).select("text", "lang")
    told = langid.with_language(documents.select("doc_id", "text"), training)
    return told.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.with_quality(documents)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in columns])


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(documents, licenses.notices(spark))


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.perspectives(table(spark, folder, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s.begin.cast("string"), s.end.cast("string")))
    return views.select(
        "conv_id",
        "part",
        "perspective",
        F.size("messages").cast("long").alias("n_turns"),
        F.size("mask").cast("long").alias("n_trained"),
        "rendered",
        F.array_join(spans, ",").alias("mask"),
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    left = F.col("lines")
    return lines.dedupe(documents).select(
        "doc_id",
        left.n_lines.alias("n_lines"),
        left.n_dropped.alias("n_dropped"),
        F.sha2(left.text, 256).alias("kept_sha256"),
    )


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(documents).select("doc_id", "n_shingles", "component_id")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = codes.compress(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return found.rows.select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(codes.digest(found.books)).alias("codebooks_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.manifest(table(spark, folder, "documents"), tampered, {"text": ascii_lower(F.col("text"))})
    return found.leaves.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(found.root).alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.lit(found.root)).alias("verified"),
    )


def op13_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = binary.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_bpe": op2_bpe,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_token_counts": op4_token_counts,
        "op5_language_id": op5_language_id,
        "op6_quality_rules": op6_quality_rules,
        "op7_license_scan": op7_license_scan,
        "op8_chat_format": op8_chat_format,
        "op9_line_dedup": op9_line_dedup,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_vector_codes": op11_vector_codes,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_embedding_dedup": op13_embedding_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {name: text for name, text in sql.texts().items() if name in known}
