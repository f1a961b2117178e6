"""The batch job, the curated zone, the catalog tables, the stream, the audit."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartledger.params import Params
from cartledger.plans import audit, reports
from cartledger.plans.pipeline import curate, curate_csv
from cartledger.schemas import TABLES
from cartledger.sinks import catalog, parquet
from cartledger.sources import curated
from cartledger.staging import StageArea
from cartledger.streaming import ingest
from cartledger.warehouse import CuratedWarehouse
from tests.conftest import line, rows
from tests.test_sources import HEADER

SOME = [
    line(invoice=str(i), stock=f"S{i % 5}", customer=i % 4 or None, price=f"{i}.00", when=f"2010-{i % 3 + 1:02d}-10 08:00:00")
    for i in range(1, 25)
] + [line(invoice="1", stock="S1", price="1.00", when="2010-02-10 08:00:00"), line(quantity=0), line(invoice="C9", quantity=-1)]


@pytest.fixture(scope="module")
def run(lines_of, tmp_path_factory):
    return curate(lines_of(SOME), str(tmp_path_factory.mktemp("curated")))


def test_counts_of_a_run(run):
    assert (run.quality["input_rows"], run.quality["valid_rows"], run.quality["failed_quantity"]) == (27, 26, 1)
    assert run.duplicates == 1


def test_curated_tables_are_the_built_ones(run, warehouse_of):
    built = warehouse_of(SOME).stored()
    for key in TABLES:
        assert rows(run.warehouse.table(key)) == rows(built[key].select(*TABLES[key].column_names)), key


def test_reports_agree_on_both_kinds_of_warehouse(run, warehouse_of):
    w = warehouse_of(SOME)
    for report in (reports.kpi_metrics, reports.avg_order_value_per_segment, reports.product_units_sold,
                   reports.no_sales_last_60_days, reports.top_10_customers, reports.customer_segment_distribution):
        assert rows(report(w)) == rows(report(run.warehouse)), report.__name__


def test_months_are_partitions_and_get_pruned(spark, run):
    fact = curated.read_table(spark, run.warehouse.root, "fact_orders")
    assert {r.year_month for r in fact.select("year_month").distinct().collect()} == {"2010-01", "2010-02", "2010-03", "2010-05"}
    since = curated.since(fact, F.lit("2010-03-01 00:00:00").cast("timestamp_ntz"))
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan and ">= 2010-03" in plan
    until = curated.until(fact, F.lit("2010-02-10 08:00:00").cast("timestamp_ntz"))
    assert since.count() + until.count() == fact.count()


def test_a_second_run_replaces_the_first(lines_of, tmp_path):
    root = str(tmp_path)
    curate(lines_of(SOME), root)
    again = curate(lines_of([line(when="2011-01-01 00:00:00")]), root)
    assert again.warehouse.fact.count() == 1
    assert [d for d in os.listdir(f"{root}/fact_orders") if d.startswith("year_month")] == ["year_month=2011-01"]


def test_one_file_per_small_month(lines_of, warehouse_of, tmp_path):
    parquet.write_table(warehouse_of(SOME).fact.repartition(9), str(tmp_path), "fact_orders")
    for month in os.listdir(tmp_path / "fact_orders"):
        if month.startswith("year_month"):
            assert len([f for f in os.listdir(tmp_path / "fact_orders" / month) if f.endswith(".parquet")]) == 1


def test_job_leaves_no_staged_files(spark, lines_of, tmp_path):
    area = StageArea.of(spark).root
    before = set(os.listdir(area)) if os.path.isdir(area) else set()
    curate(lines_of(SOME), str(tmp_path))
    left = set(os.listdir(area)) - before
    assert all(not os.listdir(f"{area}/{d}") for d in left)


def test_from_csv(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(HEADER + "1,A,x,2,2010-01-01 00:00:00,1.50,1.0,eire\n2,A,x,0,2010-01-01 00:00:00,1.50,1.0,eire\n")
    done = curate_csv(spark, str(raw), str(tmp_path / "out"))
    assert rows(done.warehouse.fact, "order_id", "line_total") == [("1", Decimal("3.00"))]
    assert done.quality["rejected_rows"] == 1


def test_catalog_tables(spark, warehouse_of):
    catalog.create_tables(spark)
    w = warehouse_of(SOME)
    catalog.load_tables(w)
    counts = {r.table_name: r.row_count for r in audit.table_counts(audit.catalog_table(spark)).collect()}
    assert counts == {TABLES[k].name: df.count() for k, df in w.stored().items()}
    fact = spark.table("fact_orders")
    n = fact.count()
    assert sorted(r[0] for r in fact.select("order_line_id").collect()) == list(range(1, n + 1))
    assert dict(fact.dtypes)["line_total"] == "decimal(12,2)"
    catalog.load_tables(w)
    assert spark.table("fact_orders").count() == n
    catalog.truncate_tables(spark)
    assert spark.table("fact_orders").count() == 0
    spark.sql("DROP TABLE dim_customers")
    counts = {r.table_name: r.row_count for r in audit.table_counts(audit.catalog_table(spark)).collect()}
    assert counts["dim_customers"] is None and counts["dim_products"] == 0


def test_counts_tolerate_a_missing_folder(spark, warehouse_of, tmp_path):
    parquet.write_table(warehouse_of(SOME).fact, str(tmp_path), "fact_orders")
    counts = audit.table_counts(audit.if_present(CuratedWarehouse(spark, str(tmp_path)).table))
    assert {r.table_name for r in counts.collect() if r.row_count is None} == {t.name for k, t in TABLES.items() if k != "fact_orders"}


def test_previews(warehouse_of):
    w = warehouse_of(SOME)
    assert audit.table_preview(w.table, "fact_orders", 5).count() == 5
    assert audit.table_preview(w.table, "fact_orders", 5, ordered=True).first().order_id == "1"
    for key, n in (("nothing", 10), ("fact_orders", 4), ("fact_orders", 51)):
        with pytest.raises(ValueError):
            audit.table_preview(w.table, key, n)


def test_audit_finds_each_kind_of_violation(spark, warehouse_of):
    frames = warehouse_of(SOME).stored()
    clean = {(r.table, r.check, r.column): r.violations for r in audit.constraint_audit(frames.get).collect()}
    assert set(clean.values()) == {0}
    bad = dict(frames)
    customers = frames["dim_customers"]
    bad["dim_customers"] = customers.where("customer_id <> 1").unionByName(
        customers.where("customer_id = 2").withColumns({"country": F.lit("x" * 81), "customer_segment": F.lit(None).cast("string")})
    ).withColumn("country", F.when(F.col("customer_id") != 3, F.col("country")))
    bad["fact_orders"] = frames["fact_orders"].withColumn("unit_price", F.lit(10**9).cast("decimal(14,4)"))
    found = {(r.table, r.check, r.column): r.violations for r in audit.constraint_audit(bad.get).collect()}
    lines_of_1 = frames["fact_orders"].where("customer_id = 1").count()
    assert {k: v for k, v in found.items() if v} == {
        ("dim_customers", "primary_key", "customer_id"): 1,
        ("dim_customers", "length", "country"): 1,
        ("dim_customers", "not_null", "country"): 1,
        ("fact_orders", "foreign_key", "customer_id"): lines_of_1,
        ("fact_orders", "range", "unit_price"): frames["fact_orders"].count(),
        ("customer_retention", "foreign_key", "customer_id"): 1,
    }


def test_whole_number_keys_are_checked_by_bitmaps(spark):
    table = TABLES["customer_retention"]
    ids = [*range(1, 70_000), 0, -1, -40_000, 2**31 - 1, -(2**31)]
    parent = spark.createDataFrame([(i,) for i in ids], "customer_id int")
    child = parent.unionByName(parent.limit(5)).unionByName(spark.createDataFrame([(None,)], "customer_id int"))

    def orphans(df, known):
        return audit.reference_check(df, table, "customer_id", known, "customer_id").first().violations

    assert orphans(child, parent) == 0 and orphans(child, parent.limit(0)) == len(ids) + 5
    assert orphans(child, parent.where("customer_id NOT IN (0, 5, 40000, -2147483648)")) == child.where("customer_id IN (0, 5, 40000, -2147483648)").count()
    assert orphans(child.limit(0), parent) == 0
    assert audit.key_check(child, TABLES["dim_customers"]).first().violations == 5
    plan = audit.key_check(child, TABLES["dim_customers"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_id" not in plan


GOOD = "{0},A, a Thing ,2,2010-01-01 00:00:00,1.50,1.0, eire \n"
BAD = "{0},A,,0,2010-01-01 00:00:00,1.50,1.0,eire\n{0},A,x,much,2010-01-01 00:00:00,1.50,1.0,eire\n"


def test_stream_takes_each_csv_file_once(spark, tmp_path):
    raw, zone, state = (str(tmp_path / n) for n in ("raw", "zone", "state"))
    os.makedirs(f"{raw}/2011")

    def drop(name, text):
        with open(f"{raw}/{name}", "w") as f:
            f.write(HEADER + text)

    def ingest_now():
        ingest.ingest_available(spark, raw, zone, state).awaitTermination()
        return ingest.valid_lines(spark, zone).count(), ingest.rejected_lines(spark, zone).count()

    drop("a.csv", GOOD.format(1) + BAD.format(2))
    drop("2011/b c.csv", GOOD.format(3))
    drop("notes.txt", GOOD.format(4))
    assert ingest_now() == (2, 2)
    assert ingest_now() == (2, 2)
    drop("d.csv", GOOD.format(5))
    assert ingest_now() == (3, 2)
    assert rows(ingest.valid_lines(spark, zone), "description", "country")[0] == ("A Thing", "Eire")
    rejected = ingest.rejected_lines(spark, zone)
    assert rows(rejected, "is_valid_quantity") == [(False,), (False,)]
    assert rejected.where("corrupt_record LIKE '%much%'").count() == 1
    done = curate(ingest.ingested_lines(spark, zone), str(tmp_path / "out"))
    assert (done.quality["input_rows"], done.warehouse.fact.count()) == (5, 3)


def test_streams_with_states_of_their_own_keep_all_lines(spark, tmp_path):
    zone = str(tmp_path / "zone")
    for number, folder in enumerate(("a", "b")):
        os.makedirs(tmp_path / folder)
        (tmp_path / folder / "x.csv").write_text(HEADER + GOOD.format(number))
        ingest.ingest_available(spark, str(tmp_path / folder), zone, str(tmp_path / f"state_{folder}")).awaitTermination()
    assert rows(ingest.valid_lines(spark, zone), "invoice_no") == [("0",), ("1",)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    raw, zone, state = (str(tmp_path / n) for n in ("raw", "zone", "state"))
    os.makedirs(raw)
    with open(f"{raw}/a.csv", "w") as f:
        f.write(HEADER + GOOD.format(1) + BAD.format(2))
    ingest.ingest_available(spark, raw, zone, state).awaitTermination()
    for name in os.listdir(f"{state}/commits"):  # as if the query had died before it noted the batch as done
        os.rename(f"{state}/commits/{name}", tmp_path / f"old-{name}")
    ingest.ingest_available(spark, raw, zone, state).awaitTermination()
    assert (ingest.valid_lines(spark, zone).count(), ingest.rejected_lines(spark, zone).count()) == (1, 2)


def test_the_pivot_takes_its_months_from_the_zone(spark, lines_of, tmp_path):
    from cartledger.plans import shapes

    window = Params(window_start="2010-01-01 00:00:00", window_end="2010-03-31 23:59:59")
    root = str(tmp_path / "zone")
    wanted = shapes.heatmap_pivot(curate(lines_of(SOME), root, window).warehouse)
    other = shapes.heatmap_pivot(CuratedWarehouse(spark, root, Params(window_start="1999-01-01 00:00:00", window_end="1999-12-31 00:00:00")))
    assert other.columns == wanted.columns == ["country", "country_rank", "2010-01", "2010-02", "2010-03"]
    assert rows(other) == rows(wanted)


def test_the_pivot_loses_no_month_and_no_place(warehouse_of):
    from cartledger.plans import shapes

    some = [line(invoice=str(i), customer=i, country=None if i == 1 else f"land {i:02d}", price="900" if i == 1 else "1") for i in range(1, 13)]
    some.append(line(invoice="x", customer=2, country="land 02", when="2031-07-01 00:00:00", price="7"))
    pivot = shapes.heatmap_pivot(warehouse_of(some, rules=[]))
    assert "2031-07" in pivot.columns and pivot.count() == 10 and pivot.where("country IS NULL").count() == 0


def test_stage_folder_is_the_named_one(spark):
    assert StageArea.of(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))
