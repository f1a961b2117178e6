"""Shapes that dashboards and charts draw from the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartledger.functions.dates import year_month
from cartledger.functions.money import per_unit, total
from cartledger.plans import reports
from cartledger.schemas import MONEY
from cartledger.warehouse import Warehouse

# Sizes of the top lists, and the range the order value cap may take.
TOP_COUNTRIES = 10
TOP_PRODUCTS = 5
RANKED_PRODUCTS = 50
CAP_RANGE = (200, 5000)
PERCENT = "decimal(5,2)"


def kpi_cards(w: Warehouse) -> DataFrame:
    k = reports.kpi_metrics(w)
    repeat = F.try_divide(100 * F.col("repeat_customers").cast("decimal(20,0)"), F.col("total_retention_customers"))
    value = per_unit(F.col("total_revenue"), F.col("total_orders"))
    return k.select(
        F.coalesce("total_revenue", F.lit(0).cast(MONEY)).alias("total_revenue"),
        "total_orders",
        "total_customers",
        F.coalesce(value, F.lit(0).cast(MONEY)).alias("average_order_value"),
        F.coalesce(F.round(repeat, 2), F.lit(0)).cast(PERCENT).alias("repeat_rate_pct"),
    )


def segment_share(w: Warehouse) -> DataFrame:
    """The window runs over one row per segment."""
    everyone = F.sum("count").over(Window.partitionBy())
    share = F.round(100 * F.col("count").cast("decimal(20,0)") / everyone, 1).cast(PERCENT)
    return reports.customer_segment_distribution(w).withColumn("share_pct", share)


def top_countries(w: Warehouse) -> DataFrame:
    return reports.revenue_per_country(w).limit(TOP_COUNTRIES)


def _pivot(w: Warehouse, monthly: DataFrame, ranking: DataFrame) -> DataFrame:
    """Countries of the ranking in rows; in columns every month of the date window, and any other that has revenue.

    Countries without a name are not ranked.  There is one month name per month
    of the calendar, so the list that is looked up stays short.
    """
    monthly = monthly.select("country", year_month(F.col("month")).alias("year_month"), "revenue")
    found = {r[0] for r in monthly.select("year_month").distinct().collect()}
    best = ranking.where("country IS NOT NULL").orderBy(F.desc("revenue"), F.col("country").asc_nulls_last()).limit(TOP_COUNTRIES)
    best_first = Window.orderBy(F.desc("revenue"), F.col("country").asc_nulls_last())
    ranked = best.select("country", F.row_number().over(best_first).alias("country_rank"))
    months = sorted(found.union(w.params.months()))
    return (
        monthly.join(ranked, "country")
        .groupBy("country", "country_rank")
        .pivot("year_month", months)
        .agg(total(F.col("revenue")))
        .na.fill(0, months)
        .orderBy("country_rank")
    )


def heatmap_pivot(w: Warehouse) -> DataFrame:
    """Top countries by the revenue in the monthly summary (the dashboard's choice)."""
    monthly = w.stage.table(reports.heatmap_revenue(w), "heatmap")
    return _pivot(w, monthly, monthly.groupBy("country").agg(total(F.col("revenue")).alias("revenue")))


def heatmap_pivot_by_country_revenue(w: Warehouse) -> DataFrame:
    """Top countries by the country report (the static chart's choice).

    A country's revenue is the sum of its months, so the monthly table gives both.
    """
    return heatmap_pivot(w)


def top_bottom_products(w: Warehouse) -> DataFrame:
    sold = w.stage.table(reports.product_units_sold(w), "units_sold")
    sides = []
    for side, units in (("top", F.desc("total_units")), ("bottom", F.asc("total_units"))):
        order = [units, F.asc("product_id")]
        place = F.row_number().over(Window.orderBy(*order))  # over the few rows of the limit
        sides.append(sold.orderBy(*order).limit(TOP_PRODUCTS).select(F.lit(side).alias("side"), place.alias("place"), "*"))
    return sides[0].unionByName(sides[1])


def product_ranking_top50(w: Warehouse) -> DataFrame:
    """First rows of the product ranking.

    Whatever outranks a row of this list is in the list too, so the rank among
    the listed rows is the rank among all products.
    """
    best = reports.product_revenue(w).orderBy(F.desc("total_revenue"), "product_id").limit(RANKED_PRODUCTS)
    rank = F.dense_rank().over(Window.orderBy(F.desc("total_revenue")))
    return best.withColumn("revenue_rank", rank).orderBy("revenue_rank", "product_id")


# -- distribution of order values
#
# All of these start from counts per distinct value.  Values are whole cents up
# to the cap, so there are at most 500,001 of them, however many orders.


def _value_counts(w: Warehouse, cap: int, inclusive: bool) -> DataFrame:
    low, high = CAP_RANGE
    if not low <= cap <= high:
        raise ValueError(f"cap {cap} is outside {low}..{high}")
    value = F.col("order_value")
    capped = reports.order_value_distribution(w).where((value <= cap) if inclusive else (value < cap))
    counts = capped.groupBy((value * 100).cast("long").alias("cents")).agg(F.count(F.lit(1)).alias("orders"))
    return w.stage.table(counts, "order_value_counts")


def order_value_histogram(w: Warehouse, cap: int | None = None, inclusive: bool = True) -> DataFrame:
    """Equal-width bins between the smallest and largest value, the last one closed.

    A single distinct value gets bins over half a unit to either side.  Bin
    numbers are computed in whole cents, so no value lands on the wrong side of
    an edge.  No rows when there are no orders under the cap.
    """
    bins = w.params.histogram_bins
    counts = _value_counts(w, w.params.order_value_cap if cap is None else cap, inclusive)
    pad = F.when(F.min("cents") == F.max("cents"), 50).otherwise(0)
    edges = counts.agg(
        F.struct((F.min("cents") - pad).alias("low"), (F.max("cents") + pad).alias("high")).alias("e")
    ).scalar()
    filled = (
        counts.select("orders", "cents", edges.alias("e"))
        .groupBy(F.expr(f"least({bins - 1}, (cents - e.low) * {bins} div (e.high - e.low))").alias("bin"))
        .agg(F.sum("orders").alias("orders"))
    )

    def edge(step: Column) -> Column:
        cents_times_bins = F.col("e.low") * bins + step * (F.col("e.high") - F.col("e.low"))
        return (cents_times_bins.cast("decimal(20,0)") / (100 * bins)).cast("decimal(14,5)")

    return (
        w.spark.range(bins)
        .select(F.col("id").alias("bin"), edges.alias("e"))
        .where("e.low IS NOT NULL")
        .join(filled, "bin", "left")
        .select(
            "bin",
            edge(F.col("bin")).alias("bin_low"),
            edge(F.col("bin") + 1).alias("bin_high"),
            F.coalesce("orders", F.lit(0)).alias("orders"),
        )
        .orderBy("bin")
    )


def order_value_box(w: Warehouse, cap: int | None = None) -> DataFrame:
    """Quartiles, and whiskers to the last value within 1.5 times the quartile distance.

    With n values in order, counted from 0, quartile k lies at k*n/4 - 1/2 and
    is interpolated between its neighbours.  Everything is exact, in quarters
    of a cent.
    """
    counts = _value_counts(w, w.params.order_value_cap if cap is None else cap, inclusive=True)
    up_to_here = Window.orderBy("cents").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(
        "cents", "orders", F.sum("orders").over(up_to_here).alias("upto"), F.sum("orders").over(Window.partitionBy()).alias("n")
    )

    def quartile(k: int) -> Column:
        place = f"({k} * n - 2)"  # in quarters
        below = F.min(F.expr(f"CASE WHEN upto > greatest(0, floor({place} / 4)) THEN cents END"))
        above = F.min(F.expr(f"CASE WHEN upto > least(n - 1, floor({place} / 4) + 1) THEN cents END"))
        part = F.max(F.expr(f"pmod({place}, 4)"))
        return below * (4 - part) + above * part

    box = placed.agg(
        F.sum("orders").alias("orders"),
        (4 * F.min("cents")).alias("min_value"),
        (4 * F.max("cents")).alias("max_value"),
        *[quartile(k).alias(name) for k, name in ((1, "q1"), (2, "median"), (3, "q3"))],
    )
    quartiles = box.select(F.struct("q1", "q3")).scalar()
    reached = counts.select(
        (4 * F.col("cents")).alias("v"), quartiles["q1"].alias("q1"), quartiles["q3"].alias("q3")
    ).agg(
        F.struct(
            F.min(F.expr("CASE WHEN 2 * v >= 5 * q1 - 3 * q3 THEN v END")).alias("low"),
            F.max(F.expr("CASE WHEN 2 * v <= 5 * q3 - 3 * q1 THEN v END")).alias("high"),
        )
    ).scalar()
    whiskers = box.select(
        "*",
        F.least("q1", reached["low"]).alias("lower_fence"),
        F.greatest("q3", reached["high"]).alias("upper_fence"),
    )

    def pounds(name: str) -> Column:
        return (F.col(name).cast("decimal(20,0)") / 400).cast("decimal(14,4)").alias(name)

    names = ["min_value", "lower_fence", "q1", "median", "q3", "upper_fence", "max_value"]
    return whiskers.where("orders > 0").select("orders", *[pounds(n) for n in names])


def order_value_density(w: Warehouse, cap: int | None = None) -> DataFrame:
    """Gaussian density of the values below the cap, on evenly spaced points.

    The bandwidth is Scott's: the sample deviation times n to the power -1/5.
    ``expected_orders`` scales the curve to the histogram's bins.  No rows when
    the values do not vary.
    """
    points = w.params.density_points
    counts = _value_counts(w, w.params.order_value_cap if cap is None else cap, inclusive=False)
    values = counts.select((F.col("cents") / 100.0).alias("v"), F.col("orders").cast("double").alias("orders"))
    n = F.sum("orders")
    # Squares around a whole-cent origin stay exact enough: values are below the cap.
    spread = F.sum(F.col("orders") * F.col("v") * F.col("v")) - F.pow(F.sum(F.col("orders") * F.col("v")), F.lit(2)) / n
    shape = values.agg(
        F.struct(
            n.alias("n"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            (F.sqrt(spread / F.nullif(n - 1, F.lit(0.0))) * F.pow(n, F.lit(-0.2))).alias("width"),
        )
    ).scalar()
    # Every value meets every point: at most 500,001 times the points, summed in the
    # tasks that make them, by one short loop instead of one sum per point.
    at = F.expr(f"s.low + (s.high - s.low) * point / {points - 1}")
    spread_out = values.repartition(w.spark.sparkContext.defaultParallelism).select("*", shape.alias("s")).where("s.high > s.low")
    z = (at - F.col("v")) / F.col("s.width")
    kernels = (
        spread_out.select("v", "orders", "s", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy("point")
        .agg(F.sum(F.col("orders") * F.exp(F.lit(-0.5) * z * z)).alias("kernel"))
        .select("point", "kernel", shape.alias("s"))
    )
    curve = kernels.select(
        "point",
        at.alias("order_value"),
        (F.col("kernel") / (F.col("s.n") * F.col("s.width") * F.sqrt(2 * F.pi()))).alias("density"),
        (F.col("s.n") * (F.col("s.high") - F.col("s.low")) / w.params.histogram_bins).alias("scale"),
    )
    return curve.select(
        "point",
        F.round("order_value", 6).alias("order_value"),
        F.round("density", 9).alias("density"),
        F.round(F.col("density") * F.col("scale"), 6).alias("expected_orders"),
    ).orderBy("point")
