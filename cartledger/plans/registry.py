"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cartledger.plans import reports, shapes
from cartledger.warehouse import Warehouse

Query = Callable[[Warehouse], DataFrame]

REPORTS: dict[str, Query] = {
    f.__name__: f
    for f in (
        reports.avg_order_value_per_segment,
        reports.consecutive_months_purchasers,
        reports.customer_segment_distribution,
        reports.heatmap_revenue,
        reports.kpi_metrics,
        reports.monthly_revenue_trends,
        reports.no_sales_last_60_days,
        reports.order_status_distribution,
        reports.order_value_distribution,
        reports.product_revenue_ranking,
        reports.product_units_sold,
        reports.revenue_per_country,
        reports.running_total_revenue,
        reports.top_10_customers,
        reports.top_product_per_country,
        reports.total_orders,
        reports.total_revenue,
    )
}

SHAPES: dict[str, Query] = {
    f.__name__: f
    for f in (
        shapes.heatmap_pivot,
        shapes.heatmap_pivot_by_country_revenue,
        shapes.kpi_cards,
        shapes.order_value_box,
        shapes.order_value_density,
        shapes.order_value_histogram,
        shapes.product_ranking_top50,
        shapes.segment_share,
        shapes.top_bottom_products,
        shapes.top_countries,
    )
}

# Reports of this engine's own, beside those above.
FURTHER: dict[str, Query] = {"rolling_orders": reports.rolling_orders}

VIEWS = ("monthly_revenue_trends", "order_status_distribution")


def run(name: str, warehouse: Warehouse) -> DataFrame:
    known = REPORTS | SHAPES | FURTHER
    if name not in known:
        raise KeyError(f"no report named {name!r}; there are {', '.join(sorted(known))}")
    return known[name](warehouse)


def create_views(warehouse: Warehouse) -> None:
    """Register the two reports that are views under their own names."""
    for name in VIEWS:
        run(name, warehouse).createOrReplaceTempView(name)
