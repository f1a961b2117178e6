"""What the operators need of a session."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cartledger.session import prepare
from cartledger.staging import StageArea

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Runtime settings, and a Python path on which local workers find this package.

    On a cluster the package is shipped as usual (``--py-files`` or an installed
    wheel); a path that an executor does not have is passed over.
    """
    environment = spark.sparkContext.environment
    if _ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), _ROOT]))
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # workers give freed memory back
    # Texts differ much in length: bound what a Python worker holds at a time.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return prepare(spark)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the cluster's shared folder and read back."""
    return StageArea.of(df.sparkSession).table(df, label)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")
