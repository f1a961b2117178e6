"""Global orderings: range-partitioned numbers against the plain window's."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartledger.operators import ranking
from cartledger.staging import StageArea
from tests.conftest import rows



@pytest.fixture(scope="module")
def stage(spark):
    return StageArea.of(spark)


def numbers(spark, n, distinct=7):
    return spark.range(n).select(F.col("id").cast("int"), (F.hash("id") % distinct).alias("v"))


@pytest.mark.parametrize("within", [[], ["g"]])
def test_dense_rank_is_the_window_function(spark, stage, within):
    df = numbers(spark, 500, distinct=20).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    df = stage.table(df.withColumn("v", F.when(F.col("v") != 4, F.col("v"))), "grouped")
    window = Window.partitionBy(*within).orderBy(F.col("v").desc_nulls_last())
    wanted = rows(df.withColumn("r", F.dense_rank().over(window)), "id", "r")
    assert rows(ranking.dense_rank(df, "v", "r", stage, within=within), "id", "r") == wanted


def test_keys_are_dense_and_follow_the_order(spark, stage):
    df = stage.table(numbers(spark, 777).repartition(9), "numbers")
    keyed = ranking.surrogate_key(df, "key", [F.desc("v"), F.asc("id")], stage)
    wanted = [(i + 1, *t) for i, t in enumerate(sorted(rows(df, "v", "id"), key=lambda t: (-t[0], t[1])))]
    assert rows(keyed, "key", "v", "id") == wanted
