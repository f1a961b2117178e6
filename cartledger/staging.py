"""Intermediate results as written tables in the cluster's shared folder.

A staged frame is computed once, survives the loss of any executor (readers
only need the files), and is read back with column pruning.  The folder is the
one the cluster names in ``spark.checkpoint.dir``; only a local session without
that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

WRITERS = 4  # tables written at the same time
CODEC = "zstd"  # of written tables: a good quarter smaller than Spark's default

_areas: dict[str, "StageArea"] = {}


class StageArea:
    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._jvm, self._hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._written: list[str] = []

    @classmethod
    def of(cls, spark: SparkSession) -> "StageArea":
        """The session's stage area (one folder per application)."""
        app = spark.sparkContext.applicationId
        if app not in _areas:
            area = cls(spark, f"{_shared_folder(spark)}/cartledger/{app}")
            _areas[app] = area
            atexit.register(area._release_at_exit)
        return _areas[app]

    @classmethod
    def for_job(cls, spark: SparkSession, job: str) -> "StageArea":
        """A separate area that a job releases when it ends."""
        return cls(spark, f"{cls.of(spark).root}/{job}-{uuid.uuid4().hex}")

    def path(self, label: str) -> str:
        """A fresh, unused folder name below the area."""
        path = f"{self.root}/{label}-{uuid.uuid4().hex}"
        self._written.append(path)
        return path

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Write the frame now and return a reader of what was written."""
        path = self.path(label)
        df.write.option("compression", CODEC).parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def tables(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write several frames at the same time, so that one's last tasks do not idle the cluster."""
        with ThreadPoolExecutor(WRITERS) as pool:
            staged = {label: pool.submit(self.table, df, label) for label, df in frames.items()}
            return {label: job.result() for label, job in staged.items()}

    def release(self) -> None:
        """Delete the folders this area has handed out."""
        while self._written:
            self._delete(self._written.pop())

    def _delete(self, path: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self._hadoop).delete(path, True)

    def _release_at_exit(self) -> None:
        """The whole area goes when the application ends, its session stopped or not."""
        try:
            self._delete(self.root)
        except (Py4JError, OSError):
            pass  # the JVM has gone first


def _shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cartledger-stage-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own
