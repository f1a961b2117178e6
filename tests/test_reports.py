"""Reports and shapes where hand-written lines say more than the tables do."""

import datetime as dt
from decimal import Decimal

import pytest

from cartledger.params import Params
from cartledger.plans import registry, reports, shapes
from tests.conftest import line, rows

D = Decimal


def test_sixty_days_are_counted_to_the_second(warehouse_of):
    w = warehouse_of(
        [
            line(invoice="C1", stock="LATEST", when="2011-03-02 12:00:00", quantity=-1),
            line(invoice="2", stock="EDGE", when="2011-01-01 12:00:00"),
            line(invoice="3", stock="OLD", when="2011-01-01 11:59:59"),
            line(invoice="4", stock="NEVER", quantity=0),
        ]
    )
    assert rows(reports.no_sales_last_60_days(w), "product_id") == [("NEVER",), ("OLD",)]


def test_consecutive_months_cross_the_year(warehouse_of):
    w = warehouse_of(
        [
            line(invoice="1", customer=1, when="2010-12-31 00:00:00"),
            line(invoice="2", customer=1, when="2011-01-01 00:00:00"),
            line(invoice="3", customer=2, when="2010-01-01 00:00:00"),
            line(invoice="4", customer=2, when="2010-03-01 00:00:00"),
            line(invoice="5", customer=3, when="2010-05-01 00:00:00"),
            line(invoice="C6", customer=3, when="2010-06-01 00:00:00", quantity=-1),
        ]
    )
    assert rows(reports.consecutive_months_purchasers(w)) == [(1,)]


def test_totals_with_and_without_customers(warehouse_of):
    w = warehouse_of([line(price="1.00"), line(customer=None, invoice="2", price="5.00"), line(invoice="C3", quantity=-1)])
    assert rows(reports.total_revenue(w)) == [(D("6.00"),)]
    assert rows(reports.total_orders(w)) == [(2,)]
    assert rows(reports.revenue_per_country(w)) == [("United Kingdom", D("1.00"))]
    assert rows(reports.order_status_distribution(w)) == [("Cancelled", 1), ("Completed", 2)]


def test_kpis_of_nothing(warehouse_of):
    w = warehouse_of([])
    assert rows(reports.kpi_metrics(w)) == [(None, 0, 0, 0, 0)]
    assert rows(shapes.kpi_cards(w)) == [(D(0), 0, 0, D(0), D(0))]


def test_kpi_cards(warehouse_of):
    w = warehouse_of(
        [line(invoice="1"), line(invoice="2"), line(invoice="3", customer=2), line(invoice="4", customer=3), line(customer=9, quantity=0)]
    )
    assert rows(shapes.kpi_cards(w)) == [(D("4.00"), 4, 4, D("1.00"), D("33.33"))]


def test_running_total(warehouse_of):
    w = warehouse_of([line(invoice=str(m), when=f"2010-{m:02d}-15 00:00:00", price=f"{m}.00") for m in (1, 2, 4)])
    assert rows(reports.running_total_revenue(w)) == [
        (dt.date(2010, 1, 1), D(1), D(1)),
        (dt.date(2010, 2, 1), D(2), D(3)),
        (dt.date(2010, 4, 1), D(4), D(7)),
    ]


def test_best_product_ties_all_stay(warehouse_of):
    sold = (("A", "2.00", 1, "eire"), ("B", "2.00", 1, "eire"), ("C", "1.00", 1, "eire"), ("C", "9.00", 2, None))
    w = warehouse_of([line(invoice=str(c), stock=s, price=p, customer=c, country=k) for s, p, c, k in sold])
    got = sorted(tuple(r) for r in reports.top_product_per_country(w).select("product_id", "product_rank").collect())
    assert got == [("A", 1), ("B", 1), ("C", 1)]


def test_ranked_products_share_ranks(warehouse_of):
    w = warehouse_of([line(stock=f"S{i:02d}", price=f"{i // 2}.00") for i in range(60)])
    top = shapes.product_ranking_top50(w).collect()
    everything = {r.product_id: r.revenue_rank for r in reports.product_revenue_ranking(w).collect()}
    assert len(top) == 50
    assert all(everything[r.product_id] == r.revenue_rank for r in top)


def test_top_and_bottom_products(warehouse_of):
    w = warehouse_of([line(stock=s, quantity=q) for s, q in zip("ABCDEFG", (7, 7, 5, 4, 3, 2, 1))])
    got = [(r.side, r.place, r.product_id) for r in shapes.top_bottom_products(w).collect()]
    assert sorted(got) == sorted(
        [("top", i + 1, s) for i, s in enumerate("ABCDE")] + [("bottom", i + 1, s) for i, s in enumerate("GFEDC")]
    )


def test_heatmap_has_every_month_of_the_window(warehouse_of):
    w = warehouse_of([line(invoice=str(i), customer=i, country=f"land {i}", price=f"{i}.00") for i in range(1, 13)])
    for build in (shapes.heatmap_pivot, shapes.heatmap_pivot_by_country_revenue):
        got = build(w).collect()
        assert [r.country for r in got] == [f"Land {i}" for i in range(12, 2, -1)]
        assert [r.country_rank for r in got] == list(range(1, 11))
        assert got[0]["2010-05"] == D("12.00") and got[0]["2010-06"] == 0
        assert len(got[0]) == 2 + 25


def orders_worth(*values):
    return [line(invoice=str(i), price=v) for i, v in enumerate(values)]


def test_histogram_edges(warehouse_of):
    w = warehouse_of(orders_worth("0.00", "1.00", "1.50", "2.00", "5.00", "1000.00", "1000.01"))
    got = shapes.order_value_histogram(w.__class__(w.lines, Params(histogram_bins=3))).collect()
    assert [(r.bin, r.orders) for r in got] == [(0, 4), (1, 0), (2, 1)]  # 0.00 is no order value, 1000.01 above the cap
    assert (got[0].bin_low, got[0].bin_high, got[2].bin_high) == (D("1"), D("334"), D("1000"))
    below = shapes.order_value_histogram(w, inclusive=False).collect()
    assert sum(r.orders for r in below) == 4 and len(below) == 40


def test_histogram_of_one_value_and_of_none(warehouse_of):
    got = shapes.order_value_histogram(warehouse_of(orders_worth("7.00", "7.00"))).collect()
    assert {r.bin: r.orders for r in got if r.orders} == {20: 2}
    assert (got[0].bin_low, got[-1].bin_high) == (D("6.5"), D("7.5"))
    assert shapes.order_value_histogram(warehouse_of([])).collect() == []


def test_cap_has_a_range(warehouse_of):
    for cap in (199, 5001):
        with pytest.raises(ValueError):
            shapes.order_value_histogram(warehouse_of([]), cap)


def test_box(warehouse_of):
    got = shapes.order_value_box(warehouse_of(orders_worth("1", "2", "3", "4", "100"))).first().asDict()
    # quartile k of 5 values lies at 5k/4 - 1/2: 0.75, 2, 3.25
    assert got == {
        "orders": 5, "min_value": D(1), "lower_fence": D(1), "q1": D("1.75"), "median": D(3),
        "q3": D(28), "upper_fence": D(28), "max_value": D(100),
    }
    assert shapes.order_value_box(warehouse_of([])).collect() == []
    assert shapes.order_value_box(warehouse_of(orders_worth("2"))).first().asDict()["median"] == D(2)


def test_density_integrates_to_one_over_a_wide_range(warehouse_of):
    w = warehouse_of(orders_worth(*[f"{400 + (i * 37) % 97}.00" for i in range(97)]))
    points = sorted(shapes.order_value_density(w).collect(), key=lambda r: r.point)
    step = points[1].order_value - points[0].order_value
    area = sum(p.density for p in points) * step
    assert len(points) == 200 and 0.8 < area < 1.0  # the tails beyond the data are cut
    assert shapes.order_value_density(warehouse_of(orders_worth("5.00"))).collect() == []


def test_reports_by_name_and_views(spark, warehouse_of):
    w = warehouse_of([line()])
    assert len(registry.REPORTS) == 17
    assert rows(registry.run("total_orders", w)) == [(1,)]
    with pytest.raises(KeyError):
        registry.run("nothing", w)
    registry.create_views(w)
    assert spark.sql("SELECT country, year, month FROM monthly_revenue_trends").first() == ("United Kingdom", 2010, 5)
    assert spark.sql("SELECT order_status, total_orders FROM order_status_distribution").first() == ("Completed", 1)
