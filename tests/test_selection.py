"""Tiles by selection against the plain window's ``ntile``."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartledger.operators import selection
from cartledger.staging import StageArea
from tests.conftest import rows

METRICS = {"a": "day", "b": "times", "c": "money"}


@pytest.fixture(params=[(1024, 2048), (3, 1), (2, 5)])
def steps(request, monkeypatch):
    """Also with so few buckets and rows that every border takes many rounds."""
    monkeypatch.setattr(selection, "BUCKETS", request.param[0])
    monkeypatch.setattr(selection, "FEW", request.param[1])


def table(spark, n, distinct):
    df = spark.range(n).select(
        (F.hash("id") % 1000 * 1000 + F.col("id")).cast("int").alias("customer"),
        F.date_add(F.lit("2010-01-01").cast("date"), (F.hash("id", F.lit(1)) % distinct)).alias("day"),
        (F.hash("id", F.lit(2)) % distinct).alias("times"),
        ((F.hash("id", F.lit(3)) % (distinct * 1000)).cast("decimal(30,4)") / 7).cast("decimal(35,4)").alias("money"),
    )
    return StageArea.of(spark).table(df.withColumn("day", F.when(F.col("times") != 1, F.col("day"))), "metrics")


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 11, 200])
@pytest.mark.parametrize("distinct", [1, 20])
def test_tiles_are_those_of_ntile(spark, steps, n, distinct):
    df = table(spark, n, distinct)
    wanted = df
    for name, metric in METRICS.items():
        wanted = wanted.withColumn(name, F.ntile(5).over(Window.orderBy(F.col(metric).asc_nulls_first(), "customer")))
    assert rows(selection.tiles(df, 5, METRICS, "customer"), "customer", *METRICS) == rows(wanted, "customer", *METRICS)


def test_large_values_and_sizes(spark):
    df = StageArea.of(spark).table(
        spark.range(30_003).select(
            F.col("id").cast("int").alias("customer"),
            (F.col("id").cast("decimal(20,0)") * F.lit("98765432109876543").cast("decimal(17,0)")).cast("decimal(35,4)").alias("money"),
            F.lit(1).alias("one"),
        ),
        "metrics",
    )
    got = selection.tiles(df, 5, {"m": "money", "o": "one"}, "customer")
    assert sorted(r["count"] for r in got.groupBy("m").count().collect()) == [6000, 6000, 6001, 6001, 6001]
    assert got.where("m <> o").count() == 0


def test_no_sort_and_no_exchange_over_the_rows(spark):
    plan = selection.tiles(table(spark, 100, 9), 5, METRICS, "customer")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert all(word not in text for word in ("Sort", "Exchange", "Window"))
