"""A clustered fact table: same rows, fewer row groups to read."""

from glob import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cartledger.operators import clustering
from cartledger.plans.pipeline import curate
from cartledger.sinks import parquet
from cartledger.staging import StageArea
from tests.conftest import line, rows


def row_groups(folder, column, value):
    """Row groups whose statistics allow the value, and all."""
    held = total = 0
    for path in glob(f"{folder}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        place = meta.schema.to_arrow_schema().get_field_index(column)
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(place).statistics
            total += 1
            held += stats.min <= value <= stats.max
    return held, total


@pytest.fixture(scope="module")
def fact(spark):
    n = 60_000
    made = spark.range(n).select(
        (F.hash("id", F.lit(1)) % 500 + 500).alias("customer_id"),
        F.concat(F.lit("P"), F.lpad((F.hash("id", F.lit(2)) % 500 + 500).cast("string"), 4, "0")).alias("product_id"),
        F.expr("timestamp_ntz'2010-01-01 00:00:00' + make_interval(0, cast(id % 2 AS int))").alias("order_date"),
        F.sha2(F.col("id").cast("string"), 256).alias("order_id"),
    )
    return StageArea.of(spark).table(made, "lines")


def test_one_customer_or_product_reads_few_row_groups(spark, fact, tmp_path):
    folders = {}
    for name, by in (("plain", ()), ("clustered", parquet.CLUSTERED)):
        folders[name] = str(tmp_path / name)
        parquet.write_parquet(fact, folders[name], "order_date", by, row_group_bytes=64 << 10)
    read = spark.read.parquet(folders["clustered"]).drop("year_month")
    assert rows(read.groupBy("customer_id").count()) == rows(fact.groupBy("customer_id").count()) and read.count() == fact.count()
    for column, value in (("customer_id", 321), ("product_id", "P0321")):
        plain, all_plain = row_groups(folders["plain"], column, value)
        held, total = row_groups(folders["clustered"], column, value)
        assert plain == all_plain and total >= 20
        assert held <= total // 2, (column, held, total)  # all of them without the layout


def test_steps_and_keys(spark):
    df = spark.createDataFrame([(v, s) for v, s in zip([None, 1, 5, 9, 9], ["a", None, "b", "c", "d"])], "v int, s string")
    cuts = {"v": [5, 9], "s": ["b"]}
    got = df.select("v", clustering.step(F.col("v"), cuts["v"]).alias("n"), clustering.z_key(cuts, 2).alias("key"))
    assert [(r.v, r.n, r.key) for r in got.collect()] == [(None, 0, 0), (1, 0, 0), (5, 1, 3), (9, 2, 6), (9, 2, 6)]
    found = clustering.quantiles(df, ["v", "s"], 1)
    assert found == {"v": [9], "s": ["c"]}
    assert clustering.quantiles(df.limit(0), ["v"], 3) == {"v": []}


def test_a_clustered_run_has_the_same_tables(lines_of, warehouse_of, tmp_path):
    some = [line(invoice=str(i), customer=i % 5 or None, stock=f"S{i % 3}", when=f"2010-0{i % 4 + 1}-01 00:00:00") for i in range(40)]
    run = curate(lines_of(some), str(tmp_path), clustered=True)
    assert rows(run.warehouse.fact) == rows(warehouse_of(some).fact)
