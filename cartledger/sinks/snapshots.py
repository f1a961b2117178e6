"""A zone of tables published in versions: all of them at once, or none.

    root/_versions/0000000007.json            the manifest of version 7
    root/fact_orders/year_month=2010-01/bucket=3/commit=<id>/*.parquet
    root/dim_products/commit=<id>/*.parquet

A table is made of cells (its partitions; a table without partitions is one
cell), and a cell's files lie in a folder of the write they came with.  Nothing
that exists is ever changed: a commit writes the cells it has new ones for, and a
manifest, the last file, says for every table which commit's folder each cell is
read from.  Its renaming into place is the commit point.  A run that dies before
leaves the former version as it was, and its own folders unnamed; a reader opens
one manifest and keeps reading what that names, whatever is published meanwhile.
Cells that did not change are shared by versions.

Two writers: the second finds its version taken and has to start again from the
new one.  That is as strict as the store's rename is (HDFS and local folders);
on an object store let one writer publish at a time.

:func:`vacuum` deletes old manifests and the folders no kept one names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.staging import CODEC

VERSIONS, COMMIT = "_versions", "commit"
WHOLE = ""  # the one cell of a table without partitions


class Conflict(RuntimeError):
    """Somebody else has published the version in the meantime."""


class Files:
    """The few file operations that are not Spark reads or writes, on whatever store the URI names."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, uri: str):
        return self._jvm.org.apache.hadoop.fs.Path(uri)

    def found(self, pattern: str) -> list[tuple[str, int]]:
        """URI and modification time (seconds) of what the pattern matches."""
        return [(s.getPath().toString(), s.getModificationTime() / 1000) for s in self._fs.globStatus(self.path(pattern)) or []]

    def exists(self, uri: str) -> bool:
        return self._fs.exists(self.path(uri))

    def write(self, uri: str, text: str) -> None:
        out = self._fs.create(self.path(uri), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def rename(self, source: str, target: str) -> bool:
        """Whether the target was free and now is the source; its folder is made if need be."""
        self._fs.mkdirs(self.path(target).getParent())
        return not self.exists(target) and self._fs.rename(self.path(source), self.path(target))

    def delete(self, uri: str) -> None:
        self._fs.delete(self.path(uri), True)


@dataclass
class Snapshot:
    """One version: which folder each cell of each table is read from."""

    spark: SparkSession
    root: str
    version: int
    cells: dict[str, dict[str, str]] = field(default_factory=dict)  # table -> cell -> commit
    schemas: dict[str, dict] = field(default_factory=dict)  # table -> its columns, partitions among them
    info: dict = field(default_factory=dict)

    def has(self, table: str) -> bool:
        return table in self.schemas

    def read(self, table: str, cells: Iterable[str] | None = None) -> DataFrame:
        """The table, or some of its cells; cells the version does not have are passed over."""
        schema = T.StructType.fromJson(self.schemas[table])
        known = self.cells[table]
        wanted = sorted(known if cells is None else set(cells) & set(known))
        base = f"{self.root}/{table}"
        folders = ["/".join(filter(None, [base, cell, f"{COMMIT}={known[cell]}"])) for cell in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        with_commit = schema.add(T.StructField(COMMIT, T.StringType()))
        return self.spark.read.schema(with_commit).option("basePath", base).parquet(*folders).drop(COMMIT)


class Zone:
    """The versions below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def versions(self) -> list[int]:
        names = [uri.rsplit("/", 1)[1] for uri, _ in self.files.found(f"{self.root}/{VERSIONS}/*.json")]
        return sorted(int(name[:-5]) for name in names if name[:-5].isdigit())

    def manifest(self, version: int) -> str:
        return f"{self.root}/{VERSIONS}/{version:010d}.json"

    def at(self, version: int) -> Snapshot:
        text = self.spark.read.text(self.manifest(version), wholetext=True).first()[0]
        return Snapshot(self.spark, self.root, version, **json.loads(text))

    def latest(self) -> Snapshot | None:
        versions = self.versions()
        return self.at(versions[-1]) if versions else None

    def begin(self) -> "Commit":
        return Commit(self, self.latest())


class Commit:
    """The next version in the making; :attr:`pending` reads as it would read once published."""

    def __init__(self, zone: Zone, base: Snapshot | None):
        self.zone, self.base, self.id = zone, base, uuid.uuid4().hex
        version = base.version + 1 if base else 1
        old = base or Snapshot(zone.spark, zone.root, 0)
        self.pending = Snapshot(
            zone.spark, zone.root, version, {t: dict(c) for t, c in old.cells.items()}, dict(old.schemas), dict(old.info)
        )

    def clear(self) -> None:
        """Start from nothing instead of the base; the version stays the next one."""
        self.pending.cells.clear()
        self.pending.schemas.clear()
        self.pending.info.clear()

    def write(
        self,
        table: str,
        df: DataFrame,
        by: Sequence[str] = (),
        replaced: Iterable[str] | None = None,
        gather: bool = True,
        mark: str | None = None,
    ) -> None:
        """Write cells of a table, one per value of the columns ``by``.

        ``replaced`` names the cells that the frame stands for: those it has no
        row of are gone.  Without it the frame stands for the whole table.  Rows
        of a cell are gathered from all tasks, unless the frame comes gathered.
        ``mark`` names a boolean column that is no part of the table: cells in which
        no row has it stay as they were.
        """
        base, own = f"{self.zone.root}/{table}", uuid.uuid4().hex  # a table may be written again before it is published
        out = df.hint("rebalance", *[F.col(c) for c in by]) if by and gather else df
        out = out.withColumn(COMMIT, F.lit(own))
        out.write.mode("append").option("compression", CODEC).partitionBy(*by, COMMIT).parquet(base)
        written = self.zone.files.found("/".join([base, *["*"] * len(by), f"{COMMIT}={own}"]))
        folders = {"/".join(uri.rsplit("/", len(by) + 1)[1:-1]): uri for uri, _ in written}
        if mark is not None:
            folders = self._marked(base, folders, df, by, mark)
            replaced = folders
        kept = {} if replaced is None else {c: v for c, v in self.pending.cells.get(table, {}).items() if c not in set(replaced)}
        self.pending.cells[table] = kept | {cell: own for cell in folders}
        columns = [f for f in df.schema.fields if f.name not in (*by, mark)] + [df.schema[c] for c in by]
        self.pending.schemas[table] = T.StructType([T.StructField(f.name, f.dataType) for f in columns]).jsonValue()

    def _marked(self, base: str, folders: dict[str, str], df: DataFrame, by: Sequence[str], mark: str) -> dict[str, str]:
        """Those of the written cells in which a row is marked; the others are deleted again."""
        if not folders:
            return folders
        columns = T.StructType([df.schema[c] for c in (*by, mark)])
        rows = self.zone.spark.read.schema(columns).option("basePath", base).parquet(*folders.values())
        marked = {cell(**r.asDict()) for r in rows.where(mark).select(*by).distinct().collect()}
        for name in folders.keys() - marked:
            self.zone.files.delete(folders[name])
        return {name: uri for name, uri in folders.items() if name in marked}

    def publish(self, **info) -> Snapshot:
        """The commit point."""
        snapshot, files = self.pending, self.zone.files
        snapshot.info.update(info)
        text = json.dumps({"cells": snapshot.cells, "schemas": snapshot.schemas, "info": snapshot.info}, sort_keys=True)
        waiting = f"{self.zone.root}/{VERSIONS}/.{self.id}.tmp"
        files.write(waiting, text)
        if not files.rename(waiting, self.zone.manifest(snapshot.version)):
            files.delete(waiting)
            raise Conflict(f"version {snapshot.version} of {self.zone.root} is there already")
        return snapshot


def cell(**values) -> str:
    """The name of a cell from its partition values, in order."""
    return "/".join(f"{k}={v}" for k, v in values.items())


def vacuum(zone: Zone, keep: int = 2, grace_seconds: float = 24 * 3600) -> list[str]:
    """Delete all but the last versions, then folders that no kept one names; returns what was deleted.

    Folders younger than the grace period may belong to a commit under way and stay.
    """
    versions = zone.versions()
    kept = [zone.at(v) for v in versions[-keep:]]
    deleted = [zone.manifest(v) for v in versions[:-keep]]
    for uri in deleted:
        zone.files.delete(uri)
    named = {(t, c, commit) for s in kept for t, cells in s.cells.items() for c, commit in cells.items()}
    tables = {t: max(c.count("/") + 1 if c else 0 for c in cells) for s in kept for t, cells in s.cells.items() if cells}
    before = time.time() - grace_seconds
    for table, depth in tables.items():
        for uri, changed in zone.files.found("/".join([zone.root, table, *["*"] * depth, f"{COMMIT}=*"])):
            *path, commit = uri.rsplit("/", depth + 1)[1:]
            if (table, "/".join(path), commit.split("=", 1)[1]) not in named and changed <= before:
                zone.files.delete(uri)
                deleted.append(uri)
    return deleted
