"""Distinct orders from bitmaps against counting them."""

import pytest
from pyspark.sql import functions as F

from cartledger.operators import distinct
from cartledger.plans import incremental, reports
from cartledger.staging import StageArea
from tests.conftest import rows
from tests.test_incremental import some_lines


def counted(w, first, last):
    done = w.completed.join(w.countries, "customer_id").where(F.date_format("order_date", "yyyy-MM").between(first, last))
    return rows(done.groupBy("country").agg(F.countDistinct("order_id")))


def test_any_range_of_months(warehouse_of):
    w = warehouse_of(some_lines(11, 400))
    for first, last in (("2010-01", "2010-01"), ("2010-02", "2010-05"), ("2010-01", "2010-12"), ("2011-01", "2011-02")):
        got = distinct.distinct_orders(distinct.between(w.order_bitmaps, first, last), ["country"])
        assert rows(got) == counted(w, first, last)


def test_many_bitmaps(spark):
    orders = spark.range(100_000).select(
        F.when(F.col("id") % 2 == 0, "2010-01").otherwise("2010-02").alias("year_month"),
        (F.col("id") % 7).cast("int").alias("customer_id"),
        (F.col("id") % 80_000).cast("string").alias("order_id"),
    )
    countries = spark.range(6).select(F.col("id").cast("int").alias("customer_id"), F.lit("x").alias("country"))
    stage = StageArea.of(spark)
    numbers = stage.table(distinct.new_numbers(orders, countries, None, stage), "numbers")
    assert numbers.agg(F.min("order_no"), F.max("order_no"), F.countDistinct("order_no")).first() == (0, 79_999, 80_000)
    bitmaps = distinct.month_bitmaps(orders, countries, numbers)
    wanted = orders.where("customer_id < 6").agg(F.countDistinct("order_id")).first()[0]
    assert bitmaps.select("bitmap_no").distinct().count() == 3
    assert distinct.distinct_orders(bitmaps).first()[0] == wanted


def test_batches_keep_numbers_and_answer_alike(spark, lines_of, warehouse_of, tmp_path):
    some = some_lines(12, 200)
    for part in (some[:100], some[80:150], some[150:]):
        snapshot = incremental.take_in(spark, str(tmp_path), lines_of(part))
    zone, built = incremental.SnapshotWarehouse(snapshot), warehouse_of(some)
    assert rows(reports.rolling_orders(zone)) == rows(reports.rolling_orders(built))
    numbers = snapshot.read(incremental.NUMBERS)
    n = numbers.count()
    assert numbers.select("order_id").distinct().count() == numbers.select("order_no").distinct().count() == n
    assert rows(numbers, "order_no")[-1] == (n - 1,)
    plan = reports.rolling_orders(zone)._jdf.queryExecution().executedPlan().toString()
    assert "fact_orders" not in plan and "month_orders" not in plan


@pytest.mark.parametrize("months", [1, 2])
def test_rolling_windows(warehouse_of, months):
    w = warehouse_of(some_lines(13, 300))
    got = {(r.country, r.year_month): r.total_orders for r in reports.rolling_orders(w, months).collect()}
    for (country, until), n in got.items():
        first = f"2010-{int(until[5:]) - months + 1:02d}"
        assert dict(counted(w, first, until))[country] == n
