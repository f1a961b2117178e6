"""The batch job: raw lines to the curated zone."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cartledger.operators import quality
from cartledger.operators.quality import Rule
from cartledger.params import Params
from cartledger.schemas import TABLES
from cartledger.sinks.parquet import write_table
from cartledger.sources import csv_files, csv_ranges, curated
from cartledger.staging import WRITERS, StageArea
from cartledger.warehouse import CuratedWarehouse, Warehouse


@dataclass(frozen=True)
class Curated:
    """What a run left behind: the zone, opened for reports, and its row counts."""

    warehouse: CuratedWarehouse
    quality: dict[str, int]
    duplicates: int


def curate(
    lines: DataFrame,
    root: str,
    params: Params = Params(),
    rules: Sequence[Rule] | None = None,
    segmenter: Callable[[DataFrame], DataFrame] | None = None,
    clustered: bool = False,
) -> Curated:
    """Write the six tables below ``root``, the fact table laid out by customer and product if ``clustered``.

    The fact table is written first and everything else is built from what was
    written: lines are validated and deduplicated once, and all tables agree.
    """
    spark = lines.sparkSession
    stage = StageArea.for_job(spark, "curate")
    try:
        source = Warehouse(lines, params, rules, segmenter, stage)
        fact = stage.table(source.fact, "fact") if clustered else source.fact
        write_table(fact, root, "fact_orders", clustered)
        curated.write_params(spark, root, params)
        w = source.on_fact(curated.read_fact(spark, root))
        with ThreadPoolExecutor(WRITERS) as pool:
            counted = pool.submit(lambda: quality.summary(source.orders, source.rules).first().asDict())
            frames = {key: w.table(key) for key in TABLES if key != "fact_orders"}
            written = [pool.submit(write_table, df, root, key) for key, df in frames.items()]
            for job in written:
                job.result()
        counts = counted.result()
        return Curated(CuratedWarehouse(spark, root, params), counts, counts["valid_rows"] - w.fact.count())
    finally:
        stage.release()


def curate_csv(
    spark: SparkSession, path: str | list[str], root: str, params: Params = Params(), multi_line: bool = True, **kwargs
) -> Curated:
    """The same from raw CSV files, which are parsed once and staged as Parquet.

    Files are read range by range, also where fields may hold line breaks.
    """
    stage = StageArea.for_job(spark, "raw")
    try:
        raw = csv_ranges.read_lines(spark, path) if multi_line else csv_files.read_lines(spark, path, multi_line)
        return curate(stage.table(raw, "lines"), root, params, **kwargs)
    finally:
        stage.release()
