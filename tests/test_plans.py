"""What the plans must look like to hold at a large scale."""

import re

import pytest

from cartledger.operators import dedup, marts
from cartledger.plans import reports
from cartledger.schemas import LINE_SCHEMA
from cartledger.warehouse import CuratedWarehouse, Warehouse
from tests.conftest import line


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, lines_of, tmp_path_factory):
    """A warehouse over lines in Parquet, where pushdown can be seen."""
    path = str(tmp_path_factory.mktemp("lines") / "lines")
    lines_of([line(invoice=str(i), customer=i % 5) for i in range(50)]).write.parquet(path)
    return Warehouse(spark.read.schema(LINE_SCHEMA).parquet(path))


def test_validation_reaches_the_scan(stored):
    plan = plan_of(stored.valid_orders)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert "GreaterThanOrEqual(order_date,2009-12-01T00:00" in pushed
    assert "GreaterThanOrEqual(unit_price" in pushed
    assert "description" not in plan and "country" not in plan


def test_completed_lines_are_filtered_before_the_dedup_shuffle(stored):
    plan = plan_of(reports.total_revenue(stored))
    below_exchange = plan[plan.index("Exchange hashpartitioning(invoice_no"):]
    assert re.search(r"NOT .*StartsWith\(invoice_no#\d+, C\)", below_exchange)


def test_deduplication_reduces_before_the_shuffle_and_uses_no_window(stored):
    plan = plan_of(stored.unique_orders)
    assert "Window" not in plan and plan.count("Exchange") == 1
    assert "partial_min" in plan[plan.index("Exchange"):]
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert "SortAggregate" not in plan_of(dedup.removed_lines(stored.valid_orders))


def test_removed_lines_count_copies_before_the_shuffle(stored):
    plan = plan_of(dedup.removed_lines(stored.valid_orders))
    assert "Window" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "partial_count" in plan


@pytest.mark.parametrize(
    "report",
    [
        reports.revenue_per_country,
        reports.monthly_revenue_trends,
        reports.top_10_customers,
        lambda w: w.revenue_summary,
    ],
)
def test_lines_are_summed_per_customer_before_they_meet_the_customers(stored, report):
    plan = plan_of(report(stored))
    join = plan.index("Join [customer_id")
    assert "Aggregate(keys=[customer_id" in plan[join:]


def test_no_report_multiplies_rows(stored):
    for report in (reports.total_orders, reports.product_units_sold, reports.consecutive_months_purchasers,
                   reports.no_sales_last_60_days, reports.order_value_distribution):
        plan = plan_of(report(stored))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_figures_in_one_row_need_no_join(stored):
    plan = plan_of(reports.kpi_metrics(stored))
    assert "Join" not in plan.split("Subquery")[0]


def test_top_list_keeps_ten_rows_per_task(stored):
    assert "TakeOrderedAndProject(limit=10" in plan_of(reports.top_10_customers(stored))


def test_sixty_day_report_prunes_months(spark, lines_of, tmp_path):
    from cartledger.plans.pipeline import curate

    curate(lines_of([line(), line(invoice="2", when="2011-05-01 00:00:00")]), str(tmp_path))
    plan = plan_of(reports.no_sales_last_60_days(CuratedWarehouse(spark, str(tmp_path))))
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert any("year_month" in f and ">=" in f for f in filters), plan


def test_customer_tables_share_one_shuffled_rollup(stored):
    w = Warehouse(stored.lines)
    assert w.customer_orders is w.customer_orders
    assert "Exchange" not in plan_of(w.customer_orders)
    assert plan_of(marts.customer_retention(w.customer_orders, w.params)).count("Exchange hashpartitioning") == 1
