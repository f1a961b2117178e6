"""Raw files taken in by content: each content counts once, whatever its files are called.

A ledger holds for every path the content it has now, and for every content the
batch that loaded its lines.  A run looks at the files that are new or have
changed (size or time), and takes the digest of their lines:

- a content that some path already has (sent again, renamed, copied) is noted
  with its path and not loaded;
- a new content is loaded, once, however many new files have it;
- a path whose content changed gives up its old one; if no path has that any more,
  its lines leave the batch that loaded them.

A path that has vanished keeps its content: files are moved away once taken in.

The digest is a sum over lines, so files of any size are digested range by range in
many tasks; files that differ in the order of their lines alone are one content.
Ledger and lines are published together (:mod:`cartledger.sinks.snapshots`): a run
that dies has taken in nothing and is simply started again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.schemas import CORRUPT, LINE_SCHEMA
from cartledger.sinks.snapshots import Commit, Snapshot, Zone, cell
from cartledger.sources import csv_ranges
from cartledger.sources.csv_files import to_lines
from cartledger.staging import StageArea

FILES, CONTENTS, LINES = "files", "contents", "lines"
BATCH = "batch"


def _present(spark: SparkSession, raw_folder: str) -> DataFrame:
    """(path, location, size, modified) of the ``.csv`` files anywhere below the folder; their content is not read.

    ``path`` is the name that scans give their rows, ``location`` the one that they are asked for by.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(raw_folder)
    about = F.col("_metadata")
    return found.select(
        about.file_path.alias("path"), F.col("path").alias("location"), about.file_size.alias("size"), about.file_modification_time.cast("timestamp").alias("modified")
    )


def digests(spark: SparkSession, locations: list[str]) -> DataFrame:
    """(path, digest) of the files that have any line."""
    lines = spark.read.option("lineSep", "\n").text(locations).select(F.col("_metadata.file_path").alias("path"), "value")
    hashes = [F.xxhash64("value"), F.xxhash64(F.lit(1), "value")]
    sums = [F.sum(h.cast("decimal(20,0)")).cast("string") for h in hashes]
    summed = lines.groupBy("path").agg(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums).alias("sums"))
    return summed.select("path", F.sha2("sums", 256).alias("digest"))


def _known(commit: Commit, table: str, schema: str) -> DataFrame:
    return commit.pending.read(table) if commit.pending.has(table) else commit.zone.spark.createDataFrame([], schema)


def take_in_files(spark: SparkSession, raw_folder: str, root: str) -> Snapshot:
    """Take in what is new below the raw folder and publish the next version of the line zone at ``root``.

    If nothing is new the last version stays.
    """
    stage = StageArea.for_job(spark, "arrivals")
    try:
        commit = Zone(spark, root).begin()
        ledger = _known(commit, FILES, "path string, location string, size long, modified timestamp, digest string")
        loaded = _known(commit, CONTENTS, "digest string, batch long")
        old = ledger.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "modified")])
        changed = ~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified")))
        fresh = stage.table(_present(spark, raw_folder).join(old, "path", "left").where(changed).select("path", "location", "size", "modified"), "fresh")
        locations = [r.location for r in fresh.select("location").collect()]  # as many as Spark's own file index holds
        if not locations and commit.base:
            return commit.base
        found = digests(spark, locations) if locations else spark.createDataFrame([], "path string, digest string")
        found = fresh.join(found, "path", "left").withColumn("digest", F.coalesce("digest", F.lit("")))
        files = stage.table(ledger.join(fresh, "path", "left_anti").unionByName(found), "ledger")

        batch = commit.pending.version
        live = files.select("digest").distinct()
        missing = files.join(loaded, "digest", "left_anti").groupBy("digest").agg(F.min(F.struct("path", "location")).alias("file")).select("digest", "file.*")
        new = stage.table(missing, "new_contents")
        gone = stage.table(loaded.join(live, "digest", "left_anti"), "gone_contents")
        contents = loaded.join(live, "digest", "left_semi").unionByName(new.select("digest", F.lit(batch).cast("long").alias(BATCH)))
        # A task reads a range of files, or of one batch's lines: its rows lie in few batches as they are.
        commit.write(LINES, _lines(commit, new, gone, batch), [BATCH], replaced=_touched(gone, batch), gather=False)
        commit.write(CONTENTS, stage.table(contents, "contents"))
        commit.write(FILES, files)
        return commit.publish()
    finally:
        stage.release()


def _touched(gone: DataFrame, batch: int) -> list[str]:
    """Cells written in this run: its own, and those that lose lines."""
    return [cell(batch=batch), *[cell(batch=r[0]) for r in gone.select(BATCH).distinct().collect()]]


def _lines(commit: Commit, new: DataFrame, gone: DataFrame, batch: int) -> DataFrame:
    """The lines of new contents, and of older batches what is left of them."""
    spark = commit.zone.spark
    locations = [r.location for r in new.where("digest <> ''").select("location").collect()]
    if locations:
        raw = csv_ranges.read_raw(spark, locations, with_file=True)
        keys = new.select(csv_ranges.file_key(F.col("path")).alias("file"), "digest")
        rows = to_lines(raw.join(F.broadcast(keys), "file"), "digest").withColumn(BATCH, F.lit(batch).cast("long"))
    else:
        rows = spark.createDataFrame([], T.StructType([*LINE_SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in (CORRUPT, "digest")], T.StructField(BATCH, T.LongType())]))
    if commit.pending.has(LINES):
        old = commit.pending.read(LINES, _touched(gone, batch)).join(gone.select("digest"), "digest", "left_anti")
        rows = rows.unionByName(old.select(*rows.columns))
    return rows


def live_lines(snapshot: Snapshot) -> DataFrame:
    """All lines of the contents that some path has, as a source for the batch job."""
    return snapshot.read(LINES).select(*[f.name for f in LINE_SCHEMA.fields])


def changes(snapshot: Snapshot, before: Snapshot | None) -> tuple[DataFrame, DataFrame | None]:
    """Lines of contents that came since an earlier version (none: all), and lines of those that went."""
    lines, columns = snapshot.read(LINES), [f.name for f in LINE_SCHEMA.fields]
    if before is None:
        return lines.select(*columns), None
    old, now = before.read(CONTENTS).select("digest"), snapshot.read(CONTENTS).select("digest")
    came = lines.join(now.join(old, "digest", "left_anti"), "digest", "left_semi")
    went = before.read(LINES).join(old.join(now, "digest", "left_anti"), "digest", "left_semi")
    return came.select(*columns), went.select(*columns)
