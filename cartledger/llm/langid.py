"""Language ID: prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to two symbols, learned from all
training documents: how often each symbol followed each context.  Bytes are
folded to 157 symbols (letters without case, one blank, one digit, one for other
ASCII, every byte of a multi-byte character), so a tree has at most 157**3
counts whatever the corpus, and that bounds what is collected and broadcast.
Counting is one pass whose sums are reduced in the map tasks.

With the counts frozen, a symbol costs what escape method C gives it: its share
of (count + distinct followers) in the longest context, or the escape share
times its cost one context shorter, among the symbols not seen in the longer
one.  The costs of a context sum to probability one.  A text is coded under every
language; the shortest code wins (ties: the first language by name), and
``score`` is the posterior of that language under equal priors.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as
is everything if nothing could be learned; documents without an id are never
held out; a null language is not learned; whole texts are scored whatever their
length.  The struct column replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.llm.native import unused
from cartledger.llm.pieces import SPACES, Piece, pieces
from cartledger.llm.session import staged

BLANK, DIGIT, OTHER, BYTES = 26, 27, 28, 29
N = BYTES + 128
LANGUAGES_PER_PASS = 8
_BLOCK = 1 << 19


def _folds() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for b in range(256):
        if SPACES[b]:
            table[b] = BLANK
        elif chr(b).isdigit() and b < 128:
            table[b] = DIGIT
        elif chr(b).isalpha() and b < 128:
            table[b] = (b | 32) - ord("a")
        elif b >= 128:
            table[b] = BYTES + b - 128
    return table


FOLD = _folds()


def coded(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Context and symbol of every byte as one number, block by block, with each one's text.

    Before a text stand two blanks.
    """
    n = len(piece.data)
    for begin in range(0, n, _BLOCK):
        end = min(n, begin + _BLOCK)
        low = max(0, begin - 2)
        symbols = FOLD[piece.data[low:end]].astype(np.int32)
        symbols = np.concatenate([np.full(2 - (begin - low), BLANK, np.int32), symbols])
        owner = np.searchsorted(piece.bounds, np.arange(begin, end), "right") - 1
        into = np.arange(begin, end) - piece.bounds[owner]
        one, two = symbols[1:-1].copy(), symbols[:-2].copy()
        one[into < 1] = BLANK
        two[into < 2] = BLANK
        yield (two * N + one) * N + symbols[2:], owner


def learned_counts(training: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, code, n): how often each symbol followed each context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            offset = 0
            for piece in pieces(batch.column(0)):
                for code, owner in coded(piece):
                    keys, n = np.unique(at[offset + owner].astype(np.int64) * N**3 + code, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[keys // N**3].tolist(), pa.string()), pa.array((keys % N**3).astype(np.int32)), pa.array(n, pa.int64())],
                        ["lang", "code", "n"],
                    )
                offset += len(piece)

    found = training.select(F.col(text), F.col(lang)).mapInArrow(count, "lang string, code int, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def costs(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of every symbol: in each context of two that was seen, after each symbol, and which contexts those are."""
    seen, row = np.unique(code // N, return_inverse=True)
    two = np.zeros((len(seen), N))
    two[row, code % N] = n
    one = np.zeros((N, N))
    np.add.at(one, seen % N, two)
    p = np.full(N, 1 / N)
    p = _shares(one.sum(axis=0)[None], p[None])[0]
    p_one = _shares(one, np.broadcast_to(p, (N, N)))
    p_two = _shares(two, p_one[seen % N])
    return -np.log2(p_two).astype(np.float32), -np.log2(p_one).astype(np.float32), seen


def _shares(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in each context, from its counts and those one context shorter."""
    total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    rest = np.where(counts > 0, 0, shorter)
    left = rest.sum(axis=1, keepdims=True)
    escape = np.where(left > 0, kinds, 0)
    whole = np.maximum(total + escape, 1)
    return np.where(total > 0, np.where(counts > 0, counts / whole, escape / whole * rest / np.where(left > 0, left, 1)), shorter)


def _table(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each context, and the bits (row, symbol, language); unseen contexts share the row of their last symbol."""
    contexts = np.unique(np.concatenate([code // N for code, _ in counts.values()]))
    row_of = np.tile(np.arange(N, dtype=np.int32), N)
    row_of[contexts] = N + np.arange(len(contexts))
    table = np.zeros((N + len(contexts), N, len(counts)), np.float32)
    for i, (code, n) in enumerate(counts.values()):
        two, one, seen = costs(code, n)
        table[:N, :, i] = one
        table[N:, :, i] = one[contexts % N]
        table[row_of[seen], :, i] = two
    return row_of, table


def _scored(texts: Column, row_of, table, spark) -> Column:
    shipped = spark.sparkContext.broadcast((row_of, table))  # at most (157**2 + 157) * 157 numbers a language

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def bits(array: pa.Array) -> pa.Array:
        rows, table = shipped.value
        flat = table.reshape(-1, table.shape[2])
        parts = []
        for piece in pieces(array):
            total = np.zeros((len(piece), table.shape[2]))
            for code, owner in coded(piece):
                spent = flat[rows[code // N] * N + code % N]
                begins = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[begins]] += np.add.reduceat(spent, begins, axis=0, dtype=np.float64)
            parts.append(total)
        total = np.concatenate(parts) if parts else np.zeros((0, table.shape[2]))
        offsets = pa.array(np.arange(len(total) + 1) * table.shape[2], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))

    return bits(texts)


def with_language(documents: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", into: str = "language") -> DataFrame:
    """Add the struct (lang_pred, score), learned from the training documents."""
    spark = documents.sparkSession
    known = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = staged(learned_counts(known, text, lang), "langid_counts")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    verdict = "struct<lang_pred:string,score:double>"
    if not languages:
        return documents.withColumn(into, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")).cast(verdict))
    passes = []
    scored = documents
    for first in range(0, len(languages), LANGUAGES_PER_PASS):
        group = languages[first : first + LANGUAGES_PER_PASS]
        rows = counts.where(F.col("lang").isin(group)).toPandas()
        own = {name: rows[rows["lang"] == name] for name in group}
        row_of, table = _table({name: (r["code"].to_numpy(), r["n"].to_numpy()) for name, r in own.items()})
        column = unused(scored, f"_bits{first}")
        scored = scored.withColumn(column, _scored(F.coalesce(F.col(text), F.lit("")), row_of, table, spark))
        passes.append(column)
    every = unused(scored, "_bits")
    scored = scored.withColumn(every, F.concat(*passes))
    best = F.array_min(every)
    name = F.get(F.array(*[F.lit(x) for x in languages]), (F.array_position(every, best) - 1).cast("int"))
    others = F.aggregate(every, F.lit(0.0), lambda total, b: total + F.pow(F.lit(2.0), best - b))
    found = F.struct(
        F.when(letters, name).otherwise("und").alias("lang_pred"), F.when(letters, 1 / others).otherwise(F.lit(0.0)).alias("score")
    )
    return scored.withColumn(into, found.cast(verdict)).drop(every, *passes)


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo; null without an id."""
    return F.crc32(F.col(doc_id).cast("string")) % of
