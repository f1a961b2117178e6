"""Text expressions on Spark's built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of all contracts, as characters and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else as it is.

    Plain ASCII takes the quick built-in, and a text without capitals is itself;
    only what is left goes through the slow translation.
    """
    plain, lower = F.octet_length(text) == F.char_length(text), F.lower(text)
    return F.when(plain, lower).when(lower == text, text).otherwise(F.translate(text, _UPPER, _LOWER))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lower_words(text: Column, gap: str = SPACE_PATTERN) -> Column:
    """The words between gaps, A-Z lowered word by word; a null or blank text has none."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != ""), ascii_lower)


def unused(df: DataFrame, name: str) -> str:
    """A column name the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
