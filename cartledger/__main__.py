"""Submit entry point: ``spark-submit -m cartledger <command>`` or ``python -m cartledger``.

    etl RAW ROOT [--single-line] [--clustered]   raw CSV to the curated zone
    ingest RAW ZONE STATE            take in newly arrived CSV files, then stop
    arrive RAW ZONE                  take in new CSV files by content: each counts once, replaced ones supersede
    rebuild ZONE ROOT                lines taken in, by either command, to the curated zone
    follow ZONE ROOT                 bring a published zone up to the files taken in by "arrive"
    merge RAW ROOT [--refresh]       merge raw CSV files into a published zone (or replace it by them), as its next version
    versions ROOT                    the versions of a published zone
    vacuum ROOT [--keep N]           delete all but its last N versions and what only they use
    stats ROOT                       row counts and headline figures of a curated zone
    report NAME ROOT [--out FOLDER]  print the head of a report, or write all of it as CSV
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from cartledger.params import Params
from cartledger.plans import audit, incremental, registry
from cartledger.plans.pipeline import Curated, curate, curate_csv
from cartledger.session import prepare
from cartledger.sinks.snapshots import Zone, vacuum
from cartledger.sources import csv_files, csv_ranges
from cartledger.streaming import arrivals, ingest

REPORT_ROWS = 1000  # rows printed


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cartledger", description="Retail sales analytics on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for argument in positional:
            sub.add_argument(argument)
        return sub

    etl = command("etl", "raw", "root")
    etl.add_argument("--single-line", action="store_true", help="no line breaks in fields")
    etl.add_argument("--clustered", action="store_true", help="lay lines out by customer and product")
    command("ingest", "raw", "zone", "state")
    command("arrive", "raw", "zone")
    command("rebuild", "zone", "root")
    command("follow", "zone", "root")
    merge = command("merge", "raw", "root")
    merge.add_argument("--single-line", action="store_true", help="no line breaks in fields")
    merge.add_argument("--refresh", action="store_true", help="the files stand for all lines")
    command("versions", "root")
    command("vacuum", "root").add_argument("--keep", type=int, default=2)
    command("stats", "root")
    command("report", "name", "root").add_argument("--out", help="folder for the whole report")
    return parser.parse_args(argv)


def _tell(run: Curated) -> None:
    for name, count in run.quality.items():
        print(f"{name}: {count}")
    print(f"duplicates: {run.duplicates}")


def _show(df: DataFrame) -> None:
    df.show(REPORT_ROWS, truncate=False)
    if df.offset(REPORT_ROWS).limit(1).count():
        print(f"Only the first {REPORT_ROWS} rows are printed; --out FOLDER writes all.")


def main(argv: list[str] | None = None) -> None:
    a = _arguments(argv)
    spark = prepare(SparkSession.builder.appName(f"cartledger-{a.command}").getOrCreate())
    params = Params.from_env()
    if a.command == "etl":
        _tell(curate_csv(spark, a.raw, a.root, params, multi_line=not a.single_line, clustered=a.clustered))
    elif a.command == "ingest":
        ingest.ingest_available(spark, a.raw, a.zone, a.state, params).awaitTermination()
    elif a.command == "arrive":
        print(f"version: {arrivals.take_in_files(spark, a.raw, a.zone).version}")
    elif a.command == "rebuild":
        arrived = Zone(spark, a.zone).latest()
        lines = arrivals.live_lines(arrived) if arrived else ingest.ingested_lines(spark, a.zone)
        _tell(curate(lines, a.root, params))
    elif a.command == "follow":
        done = incremental.follow(spark, a.zone, a.root, params)
        print(f"version: {done.version}" if done else "no lines yet")
    elif a.command == "merge":
        lines = csv_files.read_lines(spark, a.raw, multi_line=False) if a.single_line else csv_ranges.read_lines(spark, a.raw)
        done = incremental.take_in(spark, a.root, lines, params, refresh=a.refresh, raw=a.raw)
        print(f"version: {done.version}")
    elif a.command == "versions":
        zone = Zone(spark, a.root)
        for version in zone.versions():
            print(f"{version}: {json.dumps(zone.at(version).info, sort_keys=True)}")
    elif a.command == "vacuum":
        print(f"deleted: {len(vacuum(Zone(spark, a.root), a.keep))}")
    elif a.command == "stats":
        w = incremental.open_zone(spark, a.root, params)
        _show(audit.table_counts(audit.if_present(w.table)))
        for name in ("total_revenue", "total_orders"):
            _show(registry.run(name, w))
    else:
        found = registry.run(a.name, incremental.open_zone(spark, a.root, params))
        if a.out:
            found.write.mode("overwrite").option("header", "true").csv(a.out)
        else:
            _show(found)


if __name__ == "__main__":
    main()
