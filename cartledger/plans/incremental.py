"""The curated zone kept up to date batch by batch.

A batch of raw lines changes the zone as if all lines so far had been curated at
once, whatever their order, and however often a line is sent again.

- *Lines.*  A line's identity includes its time, so all its copies lie in one
  month, and in one of its buckets by the hash of the identity (their number is
  the zone's own, given with its first batch).  The fact
  table is stored by these cells and is itself the index: a batch is merged with
  the cells it falls in, and only cells in which a line is new or better are
  written.
- *Months.*  Two states per month, orders per customer and sales per product, are
  sums over its lines; they are made anew for changed months only.  Summaries of a
  month follow its state; those that count customers' countries also where a
  customer's country changed.
- *Distinct orders.*  Orders keep the number they got with their first batch; months
  keep bitmaps of them per country (:mod:`cartledger.operators.distinct`).
- *Whole tables.*  Retention, segments and prices add up the months' states, not
  lines.  Names and countries are maxima, which a batch can only raise.

- *Lines withdrawn.*  When a file is replaced its old lines have to go.  Only the
  cells they lie in, and the names and countries of their products and customers,
  are made anew, from the lines that are left.

All tables of a batch are published together (:mod:`cartledger.sinks.snapshots`).
:func:`follow` keeps a zone in step with files taken in by content: the version of
the lines it stands for is in its manifest, so a run that dies is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartledger.functions.dates import year_month
from cartledger.functions.money import per_unit, total
from cartledger.operators import dedup, distinct, marts, rfm, star
from cartledger.operators.extracts import ORDER_COLUMNS
from cartledger.operators.quality import Rule
from cartledger.params import Params
from cartledger.schemas import TABLES
from cartledger.sinks.snapshots import Commit, Snapshot, Zone, cell
from cartledger.sources.curated import MONTH
from cartledger.staging import WRITERS, StageArea
from cartledger.streaming import arrivals
from cartledger.warehouse import CuratedWarehouse, Warehouse

BUCKET, BUCKETS = "bucket", 4
CELL = [MONTH, BUCKET]
MONTH_ORDERS, MONTH_PRODUCTS = "month_orders", "month_products"
COUNTRIES, NAMES = "customer_countries", "product_names"
NUMBERS, BITMAPS = "order_numbers", "order_bitmaps"


class SnapshotWarehouse(CuratedWarehouse):
    """The tables of one published version."""

    def __init__(self, snapshot: Snapshot, params: Params = Params()):
        self.spark, self.root, self.snapshot = snapshot.spark, snapshot.root, snapshot
        window = {k: snapshot.info[k] for k in ("window_start", "window_end") if k in snapshot.info}
        self.params = params.with_(**window)

    def _read(self, key: str) -> DataFrame:
        stored = self.snapshot.read(key)
        return stored.select(*TABLES[key].column_names, *([MONTH] if key == "fact_orders" else []))

    @cached_property
    def customer_orders(self) -> DataFrame:
        return whole_orders(self.snapshot.read(MONTH_ORDERS))

    @cached_property
    def order_bitmaps(self) -> DataFrame:
        return self.snapshot.read(BITMAPS)


def open_zone(spark: SparkSession, root: str, params: Params = Params(), version: int | None = None) -> CuratedWarehouse:
    """What stands below the root: a version (by default the last one), or else plain curated folders."""
    zone = Zone(spark, root)
    snapshot = zone.latest() if version is None else zone.at(version)
    return SnapshotWarehouse(snapshot, params) if snapshot else CuratedWarehouse(spark, root, params)


# -- states


def month_orders(fact: DataFrame) -> DataFrame:
    """Completed lines of a month summed per customer and order."""
    return (
        star.completed(fact)
        .groupBy(MONTH, "customer_id", "order_id")
        .agg(
            total(F.col("line_total")).alias("order_total"),
            F.sum(F.col("quantity") * F.col("unit_price")).alias("spent"),
            F.min("order_date").alias("first_line"),
            F.max("order_date").alias("last_line"),
        )
    )


def whole_orders(months: DataFrame) -> DataFrame:
    """:func:`marts.customer_orders`, from the months' states; an order may run over several."""
    return months.groupBy("customer_id", "order_id").agg(
        total(F.col("order_total")).alias("order_total"),
        F.sum("spent").alias("spent"),
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
    )


def month_products(fact: DataFrame) -> DataFrame:
    return (
        star.completed(fact)
        .groupBy(MONTH, "product_id")
        .agg(
            F.sum("quantity").alias("units_sold"),
            total(F.col("line_total")).alias("total_revenue"),
            F.sum("unit_price").alias("prices"),
            F.count("unit_price").alias("priced"),
        )
    )


def _first_day() -> Column:
    return F.to_date(F.concat(MONTH, F.lit("-01")))


def revenue_summary(months: DataFrame, countries: DataFrame) -> DataFrame:
    """The summary of each month, from its orders per customer."""
    by_country = months.where("customer_id IS NOT NULL").join(countries, "customer_id").groupBy("country", MONTH)
    summed = by_country.agg(total(F.col("order_total")).alias("total_revenue"), F.countDistinct("order_id").alias("total_orders"))
    value = per_unit(F.col("total_revenue"), F.col("total_orders")).alias("average_order_value")
    return summed.select("*", _first_day().alias("month"), value).select(*TABLES["revenue_summary"].column_names, MONTH)


# -- a batch


def _cells(df: DataFrame, *columns: str) -> list[str]:
    """Names of the cells that have rows: at most months times buckets."""
    return [cell(**r.asDict()) for r in df.select(*columns).distinct().collect()]


def _in_cells(df: DataFrame, names: Iterable[str], how: str = "left_semi") -> DataFrame:
    keys = [dict(part.split("=", 1) for part in name.split("/")) for name in names]
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k[MONTH], int(k[BUCKET])) for k in keys], f"{MONTH} string, {BUCKET} int")
    return df.join(F.broadcast(wanted), CELL, how)  # as few rows as cells


def _months(cells: Iterable[str]) -> list[str]:
    return sorted({c.split("/")[0] for c in cells})


def _placed(df: DataFrame, buckets: int, identity: Sequence[str] = dedup.IDENTITY) -> DataFrame:
    bucket = F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int")
    return df.withColumns({MONTH: year_month(F.col("order_date")), BUCKET: bucket})


def _raised(commit: Commit, table: str, arriving: DataFrame, key: str, value: str, stage: StageArea) -> DataFrame:
    """Merge a table of maxima; returns the keys that have a new or higher value.

    The table is written only if there are any.
    """
    old = commit.pending.read(table) if commit.pending.has(table) else arriving.limit(0)
    both = old.select(key, F.col(value).alias("old"), F.lit(None).cast("string").alias("new"), F.lit(True).alias("known")).unionByName(
        arriving.select(key, F.lit(None).cast("string").alias("old"), F.col(value).alias("new"), F.lit(False).alias("known"))
    )
    merged = both.groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new"), F.max("known").alias("known"))
    now = F.greatest("old", "new")  # nulls are passed over
    merged = stage.table(merged.select(key, now.alias(value), (~F.col("known") | ~now.eqNullSafe(F.col("old"))).alias("changed")), table)
    changed = merged.where("changed").select(key)
    if not commit.pending.has(table) or not changed.isEmpty():
        commit.write(table, merged.select(key, value))
    return changed


def _lowered(commit: Commit, table: str, withdrawn: DataFrame, live: DataFrame, key: str, value: str, stage: StageArea) -> DataFrame:
    """Make the rows of some keys of a table of maxima anew; returns the keys."""
    keys = stage.table(withdrawn.select(key).distinct(), "withdrawn_keys")
    old = commit.pending.read(table).join(keys, key, "left_anti")
    again = live.join(keys, key, "left_semi")
    commit.write(table, stage.table(old.select(key, value).unionByName(again.select(key, value)), table))
    return keys


def _withdraw_lines(commit: Commit, withdrawn: DataFrame, live: DataFrame, buckets: int, stage: StageArea) -> list[str]:
    """Make the cells of withdrawn lines anew from those that are left; returns the cells."""
    cells = _cells(_placed(withdrawn, buckets), *CELL)
    if cells:
        left = _in_cells(_placed(live, buckets), cells).select(*ORDER_COLUMNS)
        commit.write("fact_orders", _fact(dedup.unique_lines(left), buckets), CELL, replaced=cells, gather=False)
    return cells


def _fact(lines: DataFrame, buckets: int, *carried: str) -> DataFrame:
    """The fact table's rows, gathered by cell before the columns that follow from a line are added."""
    when, month = F.col("order_date"), "_month"
    narrow = _placed(lines, buckets).select(*lines.columns, (F.year(when) * 12 + F.month(when)).alias(month), BUCKET)
    gathered = narrow.hint("rebalance", F.col(month), F.col(BUCKET))
    return _placed(star.fact_orders(gathered, *carried), buckets, ["order_id", "product_id", "quantity", "order_date"])


def _merge_lines(commit: Commit, valid: DataFrame, buckets: int, remade: Sequence[str] = ()) -> list[str]:
    """Merge valid lines into the fact table; returns the cells that changed.

    Cells ``remade`` from all lines that count have those of the batch already.
    """
    arriving = _placed(valid, buckets)
    if remade:
        arriving = _in_cells(arriving, remade, "left_anti")
    arriving, touched = arriving.select(*ORDER_COLUMNS), _cells(arriving, *CELL)
    if commit.pending.has("fact_orders"):
        if not touched:
            return []
        old = commit.pending.read("fact_orders", touched)
        old = old.withColumnsRenamed({"order_id": "invoice_no", "product_id": "stock_code"}).select(*ORDER_COLUMNS)
    else:
        old = arriving.limit(0)
    before, merged = dict(commit.pending.cells.get("fact_orders", {})), dedup.merged_lines(old, arriving)
    commit.write("fact_orders", _fact(merged, buckets, "changed"), CELL, gather=False, mark="changed")
    return [c for c, own in commit.pending.cells["fact_orders"].items() if before.get(c) != own]


def _derive(commit: Commit, changed: list[str], recountried: DataFrame, params: Params, stage: StageArea) -> None:
    """Everything that follows from the lines, as far as it changed; tables are written at the same time."""
    zone = commit.pending
    months = _months(changed)
    stale = bool(months) or not zone.has(MONTH_ORDERS)

    def together(*jobs: Callable[[], None]) -> None:
        with ThreadPoolExecutor(WRITERS) as pool:
            for job in [pool.submit(job) for job in jobs]:
                job.result()

    def performance() -> None:
        sales = zone.read(MONTH_PRODUCTS, months).select("product_id", _first_day().alias("month"), "units_sold", "total_revenue")
        ranked = marts.product_performance(sales, stage)  # as cheap to read as a staged table
        commit.write("product_performance", ranked.withColumn(MONTH, year_month(F.col("month"))), [MONTH], replaced=months)

    def summary() -> None:
        others = [c for c in zone.cells[MONTH_ORDERS] if c not in months]
        elsewhere = _cells(zone.read(MONTH_ORDERS, others).join(recountried, "customer_id", "left_semi"), MONTH) if others else []
        again = sorted({*months, *elsewhere})
        if again or not zone.has("revenue_summary"):
            orders, countries = zone.read(MONTH_ORDERS, again), zone.read(COUNTRIES)
            commit.write("revenue_summary", revenue_summary(orders, countries), [MONTH], replaced=again)
            known = zone.read(NUMBERS) if zone.has(NUMBERS) else None
            numbers = distinct.new_numbers(orders, countries, known, stage)
            commit.write(NUMBERS, numbers.withColumn("since", F.lit(zone.version)), ["since"], replaced=[])
            commit.write(BITMAPS, distinct.month_bitmaps(orders, countries, zone.read(NUMBERS).drop("since")), [MONTH], replaced=again)

    def customers() -> None:
        orders = stage.table(whole_orders(zone.read(MONTH_ORDERS)), "customer_orders")
        retention = marts.customer_retention(orders, params)
        commit.write("customer_retention", retention.select(*TABLES["customer_retention"].column_names))
        commit.write("dim_customers", star.dim_customers(zone.read(COUNTRIES), rfm.segments(orders, stage)))

    def products() -> None:
        sums = zone.read(MONTH_PRODUCTS).groupBy("product_id")
        prices = sums.agg(per_unit(F.sum("prices"), F.sum("priced")).alias("avg_unit_price"))
        commit.write("dim_products", star.dim_products(zone.read(NAMES), prices))

    if stale:
        fact = zone.read("fact_orders", [c for c in zone.cells["fact_orders"] if c.split("/")[0] in set(months)])
        together(
            lambda: commit.write(MONTH_ORDERS, month_orders(fact), [MONTH], replaced=months),
            lambda: commit.write(MONTH_PRODUCTS, month_products(fact), [MONTH], replaced=months),
        )
    together(*([performance] if stale else []), summary, customers, products)


def take_in(
    spark: SparkSession,
    root: str,
    lines: DataFrame,
    params: Params = Params(),
    rules: Sequence[Rule] | None = None,
    buckets: int = BUCKETS,
    withdrawn: DataFrame | None = None,
    live: DataFrame | None = None,
    refresh: bool = False,
    **info,
) -> Snapshot:
    """Merge a batch of raw lines into the zone and publish the next version.

    With ``refresh`` the version stands for the batch alone, in place of all before.
    ``withdrawn`` are raw lines that no longer count, and ``live`` then all that do,
    the batch among them.  ``info`` is kept in the version's manifest.
    """
    stage = StageArea.for_job(spark, "take_in")
    try:
        commit = Zone(spark, root).begin()
        if refresh:
            commit.clear()
        buckets = commit.pending.info.get("buckets", buckets)
        batch = Warehouse(lines, params, rules, stage=stage)
        changed, recountried = [], None
        if withdrawn is not None and commit.base:
            gone, left = (Warehouse(df, params, rules, stage=stage) for df in (withdrawn, live))
            recountried = _lowered(commit, COUNTRIES, gone.countries, left.countries, "customer_id", "country", stage)
            _lowered(commit, NAMES, gone.product_names, left.product_names, "product_id", "product_name", stage)
            changed = _withdraw_lines(commit, gone.valid_orders, left.valid_orders, buckets, stage)
        raised = _raised(commit, COUNTRIES, batch.countries, "customer_id", "country", stage)
        recountried = raised if recountried is None else recountried.unionByName(raised)
        _raised(commit, NAMES, batch.product_names, "product_id", "product_name", stage)
        changed = sorted({*changed, *_merge_lines(commit, batch.valid_orders, buckets, changed)})
        _derive(commit, changed, recountried, params, stage)
        return commit.publish(window_start=params.window_start, window_end=params.window_end, buckets=buckets, **info)
    finally:
        stage.release()


def follow(
    spark: SparkSession, line_zone: str, root: str, params: Params = Params(), rules: Sequence[Rule] | None = None
) -> Snapshot | None:
    """Bring the zone at ``root`` up to the last version of the lines taken in at ``line_zone``.

    The version it stands for must still be there: keep as many when vacuuming the lines.
    """
    arrived, curated = Zone(spark, line_zone), Zone(spark, root).latest()
    last = arrived.latest()
    if last is None:
        return curated
    done = curated.info.get("lines_version", 0) if curated else 0
    if done == last.version:
        return curated
    before = arrived.at(done) if done else None
    new, gone = arrivals.changes(last, before)
    withdrawn = None if gone is None or gone.isEmpty() else gone
    return take_in(
        spark, root, new, params, rules, withdrawn=withdrawn, live=arrivals.live_lines(last), lines_version=last.version
    )
