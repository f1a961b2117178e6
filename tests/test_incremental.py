"""Batches merged into a published zone, against one run over all lines."""

import os
import random
from itertools import permutations

import pytest

from cartledger.params import Params
from cartledger.plans import incremental, reports
from cartledger.schemas import TABLES
from cartledger.sinks import snapshots
from cartledger.sinks.snapshots import Conflict, Zone
from tests.conftest import line, rows


def some_lines(seed, n=160):
    pick = random.Random(seed)
    made = []
    for _ in range(n):
        month = pick.randrange(1, 7)
        made.append(
            line(
                invoice=pick.choice(["", "", "C"]) + str(pick.randrange(40)),
                stock=f"S{pick.randrange(8)}",
                quantity=pick.choice([1, 2, 0, None]),
                when=pick.choice([None, f"2010-{month:02d}-0{pick.randrange(1, 4)} 08:00:00"]) if pick.random() < 0.1 else f"2010-{month:02d}-0{pick.randrange(1, 4)} 08:00:00",
                price=pick.choice(["1.00", "2.505", "7.25", "-1"]),
                customer=pick.choice([None, *range(1, 9)]),
                country=pick.choice(["eire", " france ", None, "united kingdom"]),
                description=pick.choice(["a thing", "A THING b", " ", None]),
            )
        )
    return made


def check(warehouse, built):
    for key, table in TABLES.items():
        assert rows(warehouse.table(key).select(*table.column_names)) == rows(built[key].select(*table.column_names)), key


def test_batches_in_any_order_equal_one_run(spark, lines_of, warehouse_of, tmp_path):
    all_lines = some_lines(1)
    parts = [all_lines[:90], all_lines[60:120], all_lines[110:]]  # some lines are sent twice
    built = warehouse_of(all_lines).stored()
    for order in list(permutations(range(3)))[::2]:
        root = str(tmp_path / "".join(map(str, order)))
        for i in order:
            snapshot = incremental.take_in(spark, root, lines_of(parts[i]))
        check(incremental.SnapshotWarehouse(snapshot), built)


def test_only_changed_cells_are_written(spark, lines_of, tmp_path):
    root = str(tmp_path)
    first = incremental.take_in(spark, root, lines_of([line(invoice=str(i), when=f"2010-0{i % 3 + 1}-01 00:00:00") for i in range(60)]))
    late = incremental.take_in(spark, root, lines_of([line(invoice="late", when="2010-02-01 00:00:00")]))
    new = {c for c, commit in late.cells["fact_orders"].items() if first.cells["fact_orders"].get(c) != commit}
    assert len(new) == 1 and new.pop().startswith("year_month=2010-02/")
    for key in ("month_orders", "month_products", "product_performance", "revenue_summary"):
        changed = {c for c, commit in late.cells[key].items() if first.cells[key].get(c) != commit}
        assert changed == {"year_month=2010-02"}, key
    again = incremental.take_in(spark, root, lines_of([line(invoice="late", when="2010-02-01 00:00:00")]))
    assert again.cells["fact_orders"] == late.cells["fact_orders"]
    assert again.cells["customer_countries"] == late.cells["customer_countries"]


def test_a_customer_moves_and_old_months_follow(spark, lines_of, warehouse_of, tmp_path):
    old = [line(invoice="1", when="2010-01-01 00:00:00", country="eire"), line(invoice="2", customer=2, when="2010-01-01 00:00:00")]
    new = [line(invoice="3", when="2010-03-01 00:00:00", country="spain")]
    incremental.take_in(spark, str(tmp_path), lines_of(old))
    snapshot = incremental.take_in(spark, str(tmp_path), lines_of(new))
    check(incremental.SnapshotWarehouse(snapshot), warehouse_of(old + new).stored())


def test_reports_on_a_published_zone(spark, lines_of, warehouse_of, tmp_path):
    some = some_lines(2)
    incremental.take_in(spark, str(tmp_path), lines_of(some))
    zone, built = incremental.open_zone(spark, str(tmp_path)), warehouse_of(some)
    for report in (reports.kpi_metrics, reports.no_sales_last_60_days, reports.top_10_customers, reports.revenue_per_country):
        assert rows(report(zone)) == rows(report(built)), report.__name__


def test_empty_batches(spark, lines_of, warehouse_of, tmp_path):
    some = some_lines(3, 40)
    for batch in ([], some, []):
        snapshot = incremental.take_in(spark, str(tmp_path), lines_of(batch))
    assert snapshot.version == 3
    check(incremental.SnapshotWarehouse(snapshot), warehouse_of(some).stored())


def test_a_run_that_dies_leaves_the_former_version(spark, lines_of, warehouse_of, tmp_path, monkeypatch):
    root, some = str(tmp_path), some_lines(4)
    incremental.take_in(spark, root, lines_of(some[:80]))
    reader = incremental.open_zone(spark, root)
    write = snapshots.Commit.write

    def dies(self, table, *args, **kwargs):
        if table == "revenue_summary":
            raise RuntimeError("killed")
        write(self, table, *args, **kwargs)

    monkeypatch.setattr(snapshots.Commit, "write", dies)
    with pytest.raises(RuntimeError, match="killed"):
        incremental.take_in(spark, root, lines_of(some[80:]))
    monkeypatch.undo()
    before = warehouse_of(some[:80]).stored()
    assert Zone(spark, root).versions() == [1]
    check(incremental.open_zone(spark, root), before)
    incremental.take_in(spark, root, lines_of(some[80:]))
    check(reader, before)  # still reads the version it opened
    check(incremental.open_zone(spark, root), warehouse_of(some).stored())
    check(incremental.open_zone(spark, root, version=1), before)


def test_vacuum_deletes_what_no_kept_version_names(spark, lines_of, warehouse_of, tmp_path):
    root, some = str(tmp_path), some_lines(5, 60)
    for end in (20, 40, 60):
        incremental.take_in(spark, root, lines_of(some[:end]))
    zone = Zone(spark, root)
    stray = zone.begin()
    stray.write("dim_products", spark.range(1).selectExpr("'x' AS product_id", "'y' AS product_name", "0 AS avg_unit_price"))
    kept = f"{root}/dim_products/commit={stray.pending.cells['dim_products']['']}"
    assert os.path.isdir(kept)
    deleted = snapshots.vacuum(zone, keep=1)
    assert [d for d in deleted if d.endswith(".json")] and os.path.isdir(kept)  # folders are too young
    assert zone.versions() == [3]
    deleted = snapshots.vacuum(zone, keep=1, grace_seconds=-5)
    assert deleted and not os.path.isdir(kept)
    check(incremental.open_zone(spark, root), warehouse_of(some).stored())
    for table, cells in zone.latest().cells.items():
        for name, commit in cells.items():
            assert os.path.isdir("/".join(filter(None, [root, table, name, f"commit={commit}"])))


def test_two_writers_do_not_share_a_version(spark, lines_of, tmp_path):
    zone = Zone(spark, str(tmp_path))
    one, two = zone.begin(), zone.begin()
    for commit in (one, two):
        commit.write("dim_products", spark.range(3).selectExpr("cast(id AS string) AS product_id"))
    one.publish(by="one")
    with pytest.raises(Conflict):
        two.publish(by="two")
    assert zone.latest().info == {"by": "one"} and zone.latest().read("dim_products").count() == 3


def test_the_window_is_kept_with_the_version(spark, lines_of, tmp_path):
    window = Params(window_start="2010-01-01 00:00:00", window_end="2010-03-31 23:59:59")
    incremental.take_in(spark, str(tmp_path), lines_of([line(when="2010-02-01 00:00:00")]), window)
    assert incremental.open_zone(spark, str(tmp_path)).params.months() == ["2010-01", "2010-02", "2010-03"]


def test_a_refresh_replaces_all_at_once(spark, lines_of, warehouse_of, tmp_path):
    root, some = str(tmp_path), some_lines(6, 80)
    incremental.take_in(spark, root, lines_of(some[:50]))
    before = incremental.open_zone(spark, root)
    incremental.take_in(spark, root, lines_of(some[50:]), refresh=True)
    check(incremental.open_zone(spark, root), warehouse_of(some[50:]).stored())
    check(before, warehouse_of(some[:50]).stored())
