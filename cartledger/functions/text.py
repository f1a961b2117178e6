"""Text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name of a product without a description.
UNNAMED_PRODUCT = "Unknown Product"


def title_case(text: Column) -> Column:
    """Blanks around the text go, words start upper case and continue lower case."""
    return F.initcap(F.trim(text))


def is_filled(text: Column) -> Column:
    """True when the text is there and is not all blanks; never null."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def product_title(description: Column) -> Column:
    return F.when(is_filled(description), title_case(description)).otherwise(F.lit(UNNAMED_PRODUCT))
