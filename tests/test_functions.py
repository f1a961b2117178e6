"""Text, money and date expressions."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cartledger.functions import dates, money, text
from cartledger.params import Params


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_titles(spark):
    assert one(spark, text.title_case(F.lit("  eire "))) == "Eire"
    assert one(spark, text.title_case(F.lit("UNITED kingdom"))) == "United Kingdom"
    assert one(spark, text.title_case(F.lit("o'neil-x"))) == "O'neil-x"
    assert one(spark, text.title_case(F.lit(None).cast("string"))) is None


def test_product_titles(spark):
    for empty in (F.lit(None).cast("string"), F.lit(""), F.lit("   ")):
        assert one(spark, text.product_title(empty)) == "Unknown Product"
    assert one(spark, text.product_title(F.lit(' 15CM "XMAS" BALL, 20'))) == '15cm "xmas" Ball, 20'


def test_line_total_rounds_once_after_multiplying(spark):
    price = F.lit("1.005").cast("decimal(14,4)")
    assert one(spark, money.line_total(F.lit(1), price)) == Decimal("1.01")
    assert one(spark, money.line_total(F.lit(10), price)) == Decimal("10.05")
    assert one(spark, money.line_total(F.lit(-1), price)) == Decimal("-1.01")


def test_division_rounds_half_up_and_survives_zero(spark):
    amount = F.lit("1.00").cast("decimal(24,2)")
    assert one(spark, money.per_unit(amount, F.lit(8))) == Decimal("0.13")
    assert one(spark, money.per_unit(amount, F.lit(3))) == Decimal("0.33")
    assert one(spark, money.per_unit(amount, F.lit(0))) is None


def test_division_is_not_rounded_twice(spark):
    # 100499999999 / 10**11 = 1.00499999999, just below the tie
    amount = F.lit("1004999999.99").cast("decimal(34,2)")
    assert one(spark, money.per_unit(amount, F.lit(10**9))) == Decimal("1.00")


def test_months(spark):
    when = F.lit("2011-02-28 23:59:59").cast("timestamp_ntz")
    assert one(spark, dates.month_of(when)) == dt.date(2011, 2, 1)
    assert one(spark, dates.year_month(when)) == "2011-02"


def test_months_of_the_window():
    months = Params().months()
    assert (months[0], months[-1], len(months)) == ("2009-12", "2011-12", 25)


def test_params_from_environment():
    env = {"LAPSED_THRESHOLD_DAYS": "90", "DATASET_START_DATE": "2010-01-01 00:00:00"}
    params = Params.from_env(env)
    assert (params.lapsed_after_days, params.window_start) == (90, "2010-01-01 00:00:00")
    assert params.window_end == Params().window_end
