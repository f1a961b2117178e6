"""The jobs with side effects as queries: run in the stage area, then read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartledger.functions.money import total
from cartledger.plans import audit, incremental
from cartledger.plans.pipeline import Curated, curate
from cartledger.schemas import RAW_SCHEMA
from cartledger.sinks.parquet import write_table
from cartledger.sinks.snapshots import Files, Zone
from cartledger.sources import csv_files, csv_ranges, curated
from cartledger.streaming import arrivals, ingest
from cartledger.warehouse import Warehouse


def _raw_csv(w: Warehouse, lines: DataFrame | None = None) -> str:
    """The warehouse's lines (or others) as files in the raw layout; returns the folder."""
    folder = w.stage.path("raw_csv")
    names = ["invoice_no", "stock_code", "description", "quantity", "order_date", "unit_price", "customer_id", "country"]
    raw = (w.lines if lines is None else lines).select(*[F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(names, RAW_SCHEMA.fields)])
    raw.write.options(
        header="true",
        escape='"',
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(folder)
    return folder


def raw_csv_scan(w: Warehouse) -> DataFrame:
    return csv_files.read_lines(w.spark, _raw_csv(w))


def raw_csv_ranges(w: Warehouse) -> DataFrame:
    """Files whose descriptions have line breaks and quotes, read range by range."""
    broken = w.lines.withColumn("description", F.replace("description", F.lit(" "), F.lit('\n"')))
    return csv_ranges.read_lines(w.spark, _raw_csv(w, broken))


def _curate(w: Warehouse) -> Curated:
    """Lines are read by the fact table, the counts and both dimensions, so they are computed first."""
    return curate(w.stage.table(w.lines, "lines"), w.stage.path("curated"), w.params, w.rules)


def curated_write(w: Warehouse) -> DataFrame:
    """What the month-partitioned fact table holds after it was written."""
    root = w.stage.path("curated")
    write_table(w.fact, root, "fact_orders")
    fact = curated.read_table(w.spark, root, "fact_orders")
    return fact.groupBy(curated.MONTH, "order_status").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("quantity").alias("units"),
        total(F.col("line_total")).alias("revenue"),
    )


LOOKED_UP = 97  # of so many customers and products one is looked up


def clustered_lookups(w: Warehouse) -> DataFrame:
    """Lines, units and revenue of some customers and some products, from a clustered fact table."""
    root = w.stage.path("clustered")
    write_table(w.stage.table(w.fact, "fact"), root, "fact_orders", clustered=True)
    fact = curated.read_fact(w.spark, root)
    figures = [F.count(F.lit(1)).alias("line_count"), F.sum("quantity").alias("units"), total(F.col("line_total")).alias("revenue")]
    found = []
    for column in ("customer_id", "product_id"):
        key = F.col(column).cast("string")
        number = F.when(key.rlike("^[0-9]{1,9}$"), key.cast("int"))
        some = fact.where(number % LOOKED_UP == 1).groupBy(key.alias("key"))
        found.append(some.agg(*figures).select(F.lit(column).alias("looked_up"), "*"))
    return found[0].unionByName(found[1])


def curated_tables(w: Warehouse) -> DataFrame:
    """Rows of each curated table after a run."""
    return audit.table_counts(_curate(w).warehouse.table)


BATCHES = 3


def _figures(w: Warehouse) -> DataFrame:
    """Each table in a few rows: how many, an amount and a number per part of it."""
    month = lambda c: F.date_format(F.col(c).cast("date"), "yyyy-MM")
    zero = F.lit(0)
    parts = {
        "fact_orders": (F.concat_ws(" ", "order_status", month("order_date")), F.sum("line_total"), F.sum("quantity")),
        "revenue_summary": (month("month"), F.sum("total_revenue"), F.sum("total_orders")),
        "product_performance": (month("month"), F.sum("total_revenue"), F.sum("overall_rank")),
        "customer_retention": (F.col("customer_status"), F.sum("lifetime_spend"), F.sum("total_orders")),
        "dim_customers": (F.coalesce("customer_segment", F.lit("none")), F.sum(zero), F.sum("customer_id")),
        "dim_products": (F.lit("all"), F.sum("avg_unit_price"), F.sum(zero)),
    }
    figures = [
        w.table(key)
        .groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("row_count"), amount.cast("double").alias("amount"), number.cast("long").alias("number"))
        .select(F.lit(key).alias("table_name"), "part", "row_count", "amount", "number")
        for key, (part, amount, number) in parts.items()
    ]
    return reduce(DataFrame.unionByName, figures)


def incremental_tables(w: Warehouse) -> DataFrame:
    """The tables of each version as batches come in one by one, the last one with lines sent before."""
    root, lines = w.stage.path("published"), w.stage.table(w.lines, "lines")
    batch = F.coalesce("customer_id", F.lit(0)) % BATCHES
    for number in range(BATCHES):
        sent_again = (F.lit(number == BATCHES - 1)) & (F.col("quantity") % 4 == 0)
        incremental.take_in(w.spark, root, lines.where((batch == number) | sent_again), w.params, w.rules)
    zone = Zone(w.spark, root)
    versions = [incremental.SnapshotWarehouse(zone.at(v), w.params) for v in zone.versions()]
    return reduce(
        DataFrame.unionByName, [_figures(v).withColumn("version", F.lit(v.snapshot.version)) for v in versions]
    )


def _land(w: Warehouse, lines: DataFrame, folder: str, name: str) -> None:
    """The lines as files ``<name>-<number>.csv`` in the folder, in place of those there are."""
    files = Files(w.spark, folder)
    for number, (uri, _) in enumerate(sorted(files.found(f"{_raw_csv(w, lines)}/part-*"))):
        target = f"{folder}/{name}-{number:05d}.csv"
        files.delete(target)
        files.rename(uri, target)


def followed_files(w: Warehouse) -> DataFrame:
    """The tables of a zone that follows files of which one is replaced."""
    raw, arrived, root = (w.stage.path(name) for name in ("arriving", "arrived", "followed"))
    every, part = w.stage.table(w.lines, "lines"), F.coalesce("customer_id", F.lit(0)) % 3 == 0
    wrong = every.where(part).withColumns({"quantity": F.col("quantity") + 1, "country": F.lit("zzz")})
    for lines, name in ((wrong, "a"), (every.where(part), "a"), (every.where(~part), "b")):
        _land(w, lines, raw, name)
        arrivals.take_in_files(w.spark, raw, arrived)
        snapshot = incremental.follow(w.spark, arrived, root, w.params, w.rules) if name == "b" or lines is wrong else None
    return _figures(incremental.SnapshotWarehouse(snapshot, w.params))


def file_arrivals(w: Warehouse) -> DataFrame:
    """Lines per country after files came, came again under other names, and were replaced."""
    raw, zone = w.stage.path("arriving"), w.stage.path("arrived")
    every, part = w.stage.table(w.lines, "lines"), F.coalesce("customer_id", F.lit(0)) % 3
    first, second, third = (every.where(part == i) for i in range(3))
    wrong = second.withColumn("quantity", F.col("quantity") + 1)
    for landings in ([(first, "a"), (wrong, "b")], [(first, "again"), (second, "b")], [(third, "c"), (third, "copy")]):
        for lines, name in landings:
            _land(w, lines, raw, name)
        snapshot = arrivals.take_in_files(w.spark, raw, zone)
    return (
        arrivals.live_lines(snapshot)
        .groupBy("country")
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.sum("quantity").alias("units"),
            F.sum(F.col("quantity") * F.col("unit_price")).alias("amount"),
        )
    )


def ingest_available_now(w: Warehouse) -> DataFrame:
    """What the stream makes of the lines, arriving as files."""
    zone = w.stage.path("lines")
    ingest.ingest_available(
        w.spark, _raw_csv(w), zone, w.stage.path("ingest_state"), w.params, w.rules
    ).awaitTermination()
    return (
        w.spark.read.parquet(zone)
        .groupBy(ingest.VERDICT)
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.sum("quantity").alias("units"),
            F.sum(F.col("quantity") * F.col("unit_price")).alias("amount"),
        )
    )
