"""The raw transaction file: CSV with a header, read with its declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.schemas import CORRUPT, RAW_SCHEMA

READ_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])


def csv_options(multi_line: bool = True) -> dict[str, str]:
    """Quotes inside a field are doubled; a row that does not parse is kept as text.

    No time layout is set: every ISO form of a date and time is read.

    ``multi_line`` lets quoted fields hold line breaks, at the price that one
    file is one task.  Switch it off for large files known to have none, so
    that they are split.
    """
    return {
        "header": "true",
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }


def read_raw(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """The file's own columns, plus the text of rows that did not parse."""
    return spark.read.schema(READ_SCHEMA).options(**csv_options(multi_line)).csv(path)


def to_lines(raw: DataFrame, *carried: str) -> DataFrame:
    """Raw columns under the names and types every operator expects, and those ``carried`` besides.

    Customer numbers arrive as ``13085.0`` and lose what stands after the point;
    one that is no number becomes null rather than an error.  The text of unparsed rows, when read, is carried on.
    """
    also = [CORRUPT] if CORRUPT in raw.columns else []
    # The names in the raw file's header, as in RAW_SCHEMA.
    return raw.select(
        F.col("Invoice").alias("invoice_no"),
        F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"),
        F.col("Quantity").alias("quantity"),
        F.col("InvoiceDate").alias("order_date"),
        F.col("Price").alias("unit_price"),
        F.col("Customer ID").try_cast("int").alias("customer_id"),
        F.col("Country").alias("country"),
        *also,
        *carried,
    )


def read_lines(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    return to_lines(read_raw(spark, path, multi_line)).drop(CORRUPT)


def unparsed_rows(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Text of the rows in which some field did not fit the declared schema."""
    raw = read_raw(spark, path, multi_line)
    # The parser only judges the columns a query uses, so the filter uses them all.
    uses_all = F.length(F.concat_ws("", *[F.col(f"`{f.name}`").cast("string") for f in RAW_SCHEMA.fields])) >= 0
    return raw.where(F.col(CORRUPT).isNotNull() & uses_all)
