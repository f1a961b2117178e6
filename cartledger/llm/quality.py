"""Quality rules: line-first cleaning.

Rules look at one line at a time:

* punctuation - too many of its words carry symbols or shout, or a short line
  does not end like a sentence, in the marks of whatever script; in scripts that
  are written without blanks four characters count like a word more;
* navigation - its words are held apart by separators, as in menus;
* boilerplate - phrases of consent banners and page footers make up a good part
  of it; a long line that mentions one stays.

Lines that fail are removed.  A document that loses too large a share of its
word characters is rejected, and so is one that fails the base rules (too few
words, or too many of them in repeated three-word windows).

Defined results: a null or empty text has no words and is rejected; a line
without words never fails and stays; equal rows get equal results; the text is
judged whole whatever its length.  The result is one struct column, which
replaces a column of that name, so no other column can clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.llm.pieces import LOWER, SMALL_PIECE, SPACES, Piece, hashes, per_text, pieces, windows, words

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 3
SEPARATORS = b"|>/-*"
SENTENCE_ENDS = ".!?\"')]:;,。．！？；：，、…।॥؟؛۔።”’»›」』）】》"
# Blocks of scripts without blanks between words: Thai and Lao, Burmese, Khmer, Chinese and Japanese.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
UNSPACED_WORD = 4  # characters
BOILERPLATE = (
    "accept all cookies",
    "click here to",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of use",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 30  # words of a line that carry a symbol
    max_shout_percent: int = 30  # words of a line that end in two exclamation marks
    max_separator_percent: int = 20  # words of a line that are a separator
    min_sentence_words: int = 3  # a shorter line has to end like a sentence
    min_phrase_percent: int = 20  # of a line's word characters, in phrases of boilerplate
    min_kept_percent: int = 50  # word characters that have to remain


RESULT = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("n_failed_lines", T.LongType()),
        T.StructField("kept_chars", T.LongType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def _marks(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_SYMBOL, _SEPARATOR = _marks(SYMBOLS), _marks(SEPARATORS)
_PHRASES = re.compile(b"(?=(" + b"|".join(re.escape(p.encode()) for p in BOILERPLATE) + b"))")
_ENDS = {n: np.array(sorted(int.from_bytes(c.encode()) for c in SENTENCE_ENDS if len(c.encode()) == n)) for n in (1, 2, 3)}


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose first bytes stand at the places given."""
    byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int32)
    lead, one, two, three = byte(0), byte(1) & 63, byte(2) & 63, byte(3) & 63
    return np.select(
        [lead < 0x80, lead < 0xE0, lead < 0xF0],
        [lead, (lead & 31) << 6 | one, (lead & 15) << 12 | one << 6 | two],
        (lead & 7) << 18 | one << 12 | two << 6 | three,
    )


def _closes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the words that end there end like a sentence."""
    last, before, first = (data[np.maximum(ends - k, 0)].astype(np.int32) for k in (1, 2, 3))
    two = before << 8 | last
    three = first << 16 | two
    return np.isin(last, _ENDS[1]) | np.isin(two, _ENDS[2]) | np.isin(three, _ENDS[3])


def _lines(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Start of every line of the piece and the index of each text's first line (n + 1 values)."""
    breaks = np.flatnonzero(piece.data == 10) + 1
    starts = np.sort(np.concatenate([breaks, piece.bounds[:-1]]), kind="stable")
    # A break that ends a text opens an empty line before the next text's first one.
    owner_starts = np.searchsorted(breaks, piece.bounds[:-1], "right") + np.arange(len(piece))
    return starts, np.append(owner_starts, len(starts))


def _repeated_words(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the words that lie in a window found twice or more in their text."""
    marked = np.zeros(len(codes) + 1, np.int64)
    found, at = windows(codes, first, REPEAT_WIDTH)
    if len(found):
        text = np.searchsorted(first, at, "right").astype(np.uint64)
        order = np.lexsort((found, text))
        f, t = found[order], text[order]
        same = (f[1:] == f[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(f), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hits = at[order[twice]]
        np.add.at(marked, hits, 1)
        np.add.at(marked, np.minimum(hits + REPEAT_WIDTH, len(codes)), -1)
    return np.cumsum(marked)[:-1] > 0


def _duplicate_lines(piece: Piece, line_starts: np.ndarray, first_line: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line."""
    ends = np.append(line_starts[1:], len(piece.data))
    closed = ends > line_starts
    closed[closed] &= piece.data[ends[closed] - 1] == 10
    codes = hashes(piece.data, line_starts, ends - closed)
    text = np.repeat(np.arange(len(piece)), np.diff(first_line))
    at = np.flatnonzero(n_words > 0)
    order = at[np.lexsort((at, codes[at], text[at]))]
    again = (codes[order][1:] == codes[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][again], minlength=len(piece))


def _judge(piece: Piece, rules: Rules) -> dict[str, np.ndarray | list]:
    data = piece.data
    starts, ends, first = words(piece)
    line_starts, first_line = _lines(piece)
    line_of = np.searchsorted(line_starts, starts, "right") - 1
    n_lines = len(line_starts)
    count = lambda flags: np.bincount(line_of[flags], minlength=n_lines)

    glyphs = ((data & 0xC0) != 0x80) & ~SPACES[data]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    line_words = np.bincount(line_of, minlength=n_lines)
    with_symbol = count(symbols[ends] > symbols[starts])
    shouted = count((ends - starts > 2) & (data[ends - 1] == 33) & (data[ends - 2] == 33))
    separators = count((ends - starts == 1) & _SEPARATOR[data[starts]])
    last_word = np.searchsorted(line_of, np.arange(n_lines), "right") - 1
    closes = _closes(data, ends[np.maximum(last_word, 0)]) if len(ends) else np.zeros(n_lines, bool)
    high = np.flatnonzero(data >= 0xE0)  # three bytes and more
    point = _code_points(data, high)
    unspaced = high[np.logical_or.reduce([(point >= low) & (point <= top) for low, top in UNSPACED])]
    unspaced = np.bincount(np.searchsorted(line_starts, unspaced, "right") - 1, minlength=n_lines)
    sentence_words = line_words + unspaced // UNSPACED_WORD

    line_ends = np.append(line_starts[1:], len(data))
    glyph_sum = np.concatenate([[0], np.cumsum(glyphs, dtype=np.int64)])
    line_chars = glyph_sum[line_ends] - glyph_sum[line_starts]
    phrases = [(m.start(), len(m[1].replace(b" ", b""))) for m in _PHRASES.finditer(LOWER[data].tobytes())]
    spots, sizes = np.array(phrases, np.int64).reshape(-1, 2).T
    phrase_chars = np.bincount(np.searchsorted(line_starts, spots, "right") - 1, sizes, minlength=n_lines)

    failed = (
        (100 * with_symbol > rules.max_symbol_percent * line_words)
        | (100 * shouted > rules.max_shout_percent * line_words)
        | (100 * separators > rules.max_separator_percent * line_words)
        | ((sentence_words < rules.min_sentence_words) & ~closes)
        | ((phrase_chars > 0) & (100 * phrase_chars >= rules.min_phrase_percent * line_chars))
    )
    failed &= line_words > 0

    word_chars = per_text(glyphs, piece.bounds)
    kept_chars = per_text(np.where(failed, 0, line_chars), first_line)
    n_words = np.diff(first)
    repeated = per_text(_repeated_words(hashes(data, starts, ends), first), first)
    base_failed = (n_words < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n_words)
    n_failed = per_text(failed, first_line)

    texts = []
    for i in range(len(piece)):
        text = piece.text(i)
        if n_failed[i]:
            drop = failed[first_line[i] : first_line[i + 1]]
            text = b"\n".join(line for line, bad in zip(text.split(b"\n"), drop) if not bad)
        texts.append(text)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_text(_SYMBOL[data], piece.bounds),
        "n_dup_lines": _duplicate_lines(piece, line_starts, first_line, line_words),
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "n_failed_lines": n_failed,
        "kept_chars": kept_chars,
        "kept": ~base_failed & (100 * kept_chars >= rules.min_kept_percent * word_chars),
        "clean_text": texts,
    }


def judge(texts: pa.Array, rules: Rules = Rules()) -> pa.StructArray:
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.binary()}
    parts = [_judge(piece, rules) for piece in pieces(texts, SMALL_PIECE)]
    columns = []
    for name in RESULT.names:
        kind = kinds.get(name, pa.int64())
        chunks = [pa.array(p[name], kind) for p in parts]
        column = pa.concat_arrays(chunks) if chunks else pa.array([], kind)
        columns.append(column.view(pa.string()) if name == "clean_text" else column)
    return pa.StructArray.from_arrays(columns, RESULT.names)


def with_quality(documents: DataFrame, text: str = "text", into: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """Add the struct of counts, verdict and cleaned text."""

    @F.arrow_udf(RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        return judge(texts, rules)

    return documents.withColumn(into, judged(F.col(text)))


def cleaned(documents: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Documents that pass, without their failed lines; the columns stay what they were."""
    columns = documents.columns
    into = "quality"
    while into in columns:
        into += "_"
    judged = with_quality(documents, text, into, rules).where(F.col(f"{into}.kept"))
    return judged.select(*[F.col(f"{into}.clean_text").alias(c) if c == text else F.col(f"`{c}`") for c in columns])
