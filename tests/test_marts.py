"""Star schema, segments and marts on hand-written lines."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartledger.operators import rfm
from cartledger.params import Params
from tests.conftest import line, rows

D = Decimal


def test_fact_status_and_totals(warehouse_of):
    w = warehouse_of(
        [
            line(invoice="1", quantity=3, price="1.005"),
            line(invoice="C2", quantity=-2, price="2.50"),
            line(invoice="C3", quantity=2, price="2.50"),
        ]
    )
    assert rows(w.fact, "order_id", "line_total", "order_status") == [
        ("1", D("3.02"), "Completed"),
        ("C2", D("-5.00"), "Cancelled"),
        ("C3", D("5.00"), "Cancelled"),
    ]


def test_product_dimension(warehouse_of):
    w = warehouse_of(
        [
            line(stock="A", description=" zebra ", price="1.00"),
            line(stock="A", description="apple", price="2.01", invoice="2"),
            line(stock="A", description="apple", price="9.00", invoice="C3", quantity=-1),
            line(stock="B", description=None),
            line(stock="B", description="ant", invoice="C4", quantity=-1),
            line(stock="C", description="rejected only", quantity=0),
            line(stock=" ", description="blank code"),
            line(stock=None, description="no code"),
        ]
    )
    assert rows(w.dim_products) == [
        (" ", "Blank Code", D("0.00")),
        ("A", "Zebra", D("1.51")),  # (1.00 + 2.01) / 2, half up
        ("B", "Unknown Product", D("1.00")),
        ("C", "Rejected Only", D("0.00")),
    ]


def test_customer_dimension_keeps_customers_without_completed_orders(warehouse_of):
    w = warehouse_of(
        [
            line(customer=1, country=" eire "),
            line(customer=1, country="france", invoice="2"),
            line(customer=2, invoice="C3", quantity=-1),
            line(customer=3, quantity=0),
            line(customer=4, country=None, invoice="5"),
            line(customer=None),
        ]
    )
    got = {r[0]: r[1:] for r in rows(w.dim_customers)}
    assert set(got) == {1, 2, 3, 4}
    assert got[1][0] == "France" and got[1][1] is not None
    assert got[2][1] is None and got[3][1] is None
    assert got[4][0] is None


@pytest.mark.parametrize(
    "scores, segment",
    [
        ((5, 5, 5), "Champions"),
        ((4, 4, 4), "Champions"),
        ((5, 4, 3), "Loyal"),
        ((1, 3, 3), "Loyal"),
        ((4, 2, 5), "New"),
        ((5, 1, 1), "New"),
        ((2, 3, 2), "At Risk"),
        ((1, 5, 1), "At Risk"),
        ((2, 2, 5), "Lapsed"),
        ((1, 1, 1), "Lapsed"),
        ((3, 3, 2), "Repeat"),
        ((3, 1, 5), "Repeat"),
        ((4, 3, 2), "Repeat"),
    ],
)
def test_segment_of_scores(spark, scores, segment):
    assert spark.range(1).select(rfm.segment_of(*[F.lit(s) for s in scores]).alias("s")).first().s == segment


def test_own_segmenter(warehouse_of):
    everyone_vip = lambda fact: fact.select("customer_id").distinct().withColumn("customer_segment", F.lit("VIP"))
    w = warehouse_of([line(), line(invoice="2", customer=2)], segmenter=everyone_vip)
    assert rows(w.dim_customers, "customer_id", "customer_segment") == [(1, "VIP"), (2, "VIP")]


def test_retention_boundaries(warehouse_of):
    last = "2011-12-01 00:05:00"  # an anonymous line sets the reference date
    w = warehouse_of(
        [
            line(invoice="0", customer=None, when=last),
            line(invoice="1", customer=1, when="2010-01-01 00:00:00"),  # one order, long ago
            line(invoice="1", customer=1, when="2010-01-01 00:00:00", stock="B"),
            line(invoice="2", customer=2, when="2011-06-04 23:59:00"),  # 180 days
            line(invoice="3", customer=2, when="2011-01-01 00:00:00"),
            line(invoice="4", customer=3, when="2011-06-03 23:59:00"),  # 181 days
            line(invoice="5", customer=3, when="2011-06-03 00:00:00"),
            line(invoice="C6", customer=4, quantity=-1),
        ]
    )
    assert rows(w.customer_retention) == [
        (1, 1, D("2.00"), dt.date(2010, 1, 1), dt.date(2010, 1, 1), "New"),
        (2, 2, D("2.00"), dt.date(2011, 1, 1), dt.date(2011, 6, 4), "Repeat"),
        (3, 2, D("2.00"), dt.date(2011, 6, 3), dt.date(2011, 6, 3), "Lapsed"),
    ]


def test_revenue_summary_counts_an_order_of_two_customers_once(warehouse_of):
    w = warehouse_of(
        [
            line(invoice="1", customer=1, price="1.00"),
            line(invoice="1", customer=2, price="2.00", stock="B"),
            line(invoice="2", customer=1, price="0.99", stock="B"),
            line(invoice="3", customer=None, price="50.00"),
            line(invoice="4", customer=1, when="2010-06-30 23:59:59"),
        ]
    )
    assert rows(w.revenue_summary) == [
        ("United Kingdom", dt.date(2010, 5, 1), D("3.99"), 2, D("2.00")),
        ("United Kingdom", dt.date(2010, 6, 1), D("1.00"), 1, D("1.00")),
    ]


def test_product_performance_ranks_ties_alike(warehouse_of):
    w = warehouse_of(
        [
            line(stock="A", price="2.00", quantity=2),
            line(stock="B", price="4.00"),
            line(stock="C", price="1.00"),
            line(stock="C", price="1.00", invoice="2", when="2010-06-01 00:00:00"),
        ]
    )
    may, june = dt.date(2010, 5, 1), dt.date(2010, 6, 1)
    assert rows(w.product_performance) == [
        ("A", may, 2, D("4.00"), 1),
        ("B", may, 1, D("4.00"), 1),
        ("C", may, 1, D("1.00"), 2),
        ("C", june, 1, D("1.00"), 1),
    ]


def test_no_lines_at_all(warehouse_of):
    w = warehouse_of([])
    for key, df in w.stored().items():
        assert df.count() == 0, key


def test_a_line_too_large_for_its_declared_type_ends_no_report(warehouse_of):
    from cartledger.plans import audit, reports

    w = warehouse_of([line(quantity=2_000_000, price="99999.99"), line(invoice="2")])
    assert reports.total_revenue(w).first()[0] == Decimal("199999980001.00")
    found = {(r.table, r.check, r.column): r.violations for r in audit.constraint_audit(w.stored().get).collect()}
    assert found["fact_orders", "range", "line_total"] == 1


def test_ranks_and_tiles_have_no_window_over_the_rows(warehouse_of):
    w = warehouse_of([line(invoice=str(i), stock=f"S{i % 9}", customer=i % 17 or None) for i in range(50)])
    from cartledger.plans import reports

    for df in (w.segments, w.product_performance, reports.product_revenue_ranking(w)):
        main = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        for chunk in main.split("BroadcastExchange")[:1]:
            assert "Window" not in chunk and "SinglePartition" not in chunk
