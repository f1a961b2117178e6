"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from tests.parity import compare, connect

FOLDER = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")

QUERIES = {name: query for name, query in driver.queries().items() if name in driver.builders()}
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, con, name):
    assert compare(con, QUERIES[name](spark, FOLDER), SQL[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_invariants(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from cartledger.plans import reports
    from cartledger.sources import star_tables
    from cartledger.warehouse import Warehouse

    w = Warehouse(star_tables.read_lines(spark, FOLDER), star_tables.PARAMS).settle()
    by_month = w.revenue_summary.agg(F.sum("total_revenue")).first()[0]
    by_country = reports.revenue_per_country(w).agg(F.sum("total_revenue")).first()[0]
    known = w.completed.where("customer_id IS NOT NULL").agg(F.sum("line_total")).first()[0]
    assert by_month == by_country == known > Decimal(0)
    assert reports.total_revenue(w).first()[0] > known
    tiles = w.segments.count()
    assert tiles == w.customer_retention.count() <= w.countries.count()
