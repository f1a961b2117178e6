"""Ingest of raw CSV files as they arrive.

Each new file below the raw folder is read once, cleaned, checked and appended
to the line zone.  Both steps look at one row at a time, so the stream keeps no
state; duplicates and all aggregates are the business of the batch job, which
looks at the whole history.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartledger.functions.text import product_title, title_case
from cartledger.operators import quality
from cartledger.operators.quality import Rule
from cartledger.params import Params
from cartledger.schemas import CORRUPT, LINE_SCHEMA
from cartledger.sources.csv_files import READ_SCHEMA, csv_options, to_lines

VERDICT, STREAM, BATCH = "verdict", "stream_id", "batch_id"


def arriving_lines(
    spark: SparkSession, raw_folder: str, multi_line: bool = True, files_per_batch: int = 1000
) -> DataFrame:
    """Lines of the ``.csv`` files anywhere below the raw folder; other files are passed over."""
    stream = (
        spark.readStream.schema(READ_SCHEMA)
        .options(**csv_options(multi_line))
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .csv(raw_folder)
    )
    return to_lines(stream)


def checked_lines(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Cleaned lines with one flag per rule and the verdict they add up to."""
    clean = lines.withColumns(
        {"country": title_case(F.col("country")), "description": product_title(F.col("description"))}
    )
    passed = reduce(and_, (F.col(r.flag) for r in rules), F.lit(True))
    return quality.flagged(clean, rules).withColumn(VERDICT, F.when(passed, "valid").otherwise("rejected"))


def ingest_available(
    spark: SparkSession,
    raw_folder: str,
    line_zone: str,
    checkpoint: str,
    params: Params = Params(),
    rules: Sequence[Rule] | None = None,
    **reading,
) -> StreamingQuery:
    """Start a query that takes in what has arrived and then stops.

    Valid and rejected lines go to partitions of their own, named after the
    query and the batch.  A batch that runs again replaces exactly those
    partitions; streams with other states write beside it.
    """
    rules = quality.default_rules(params) if rules is None else list(rules)
    stream_id = ""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        nonlocal stream_id
        stream_id = stream_id or _stream_id(spark, checkpoint)
        (
            batch.withColumns({STREAM: F.lit(stream_id), BATCH: F.lit(batch_id)})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(VERDICT, STREAM, BATCH)
            .parquet(line_zone)
        )

    return (
        checked_lines(arriving_lines(spark, raw_folder, **reading), rules)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The query's id, which its state keeps over restarts."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def _zone(spark: SparkSession, line_zone: str) -> DataFrame:
    return spark.read.option("mergeSchema", "false").parquet(line_zone)


def ingested_lines(spark: SparkSession, line_zone: str) -> DataFrame:
    """All lines taken in, valid or not, as a source for the batch job.

    The customer and product tables also cover rejected lines.
    """
    return _zone(spark, line_zone).select(*[f.name for f in LINE_SCHEMA.fields])


def valid_lines(spark: SparkSession, line_zone: str) -> DataFrame:
    return _zone(spark, line_zone).where(F.col(VERDICT) == "valid").select(*[f.name for f in LINE_SCHEMA.fields])


def rejected_lines(spark: SparkSession, line_zone: str) -> DataFrame:
    """Rejected lines with their flags and, where it did not parse, the row's text."""
    zone = _zone(spark, line_zone).where(F.col(VERDICT) == "rejected")
    flags = [c for c in zone.columns if c.startswith(quality.FLAG)]
    return zone.select(*[f.name for f in LINE_SCHEMA.fields], CORRUPT, *flags)
