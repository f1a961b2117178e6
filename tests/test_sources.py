"""Reading raw CSV, and the options for a relational store."""

import datetime as dt
from decimal import Decimal

import pytest

from cartledger.sources import csv_files
from cartledger.sources.jdbc import KeyRange, Store, count_options, read_options
from cartledger.sinks import jdbc
from tests.conftest import rows

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


@pytest.fixture
def csv(tmp_path):
    def write(*records, name="raw.csv"):
        path = tmp_path / name
        path.write_text(HEADER + "\n".join(records) + "\n")
        return str(path)

    return write


def test_fields_and_types(spark, csv):
    path = csv('489434,85048,"15CM ""XMAS"" BALL, 20",12,2009-12-01 07:45:00,6.95,13085.0,United Kingdom')
    assert rows(csv_files.read_lines(spark, path)) == [
        (
            "489434", "85048", '15CM "XMAS" BALL, 20', 12, dt.datetime(2009, 12, 1, 7, 45),
            Decimal("6.9500"), 13085, "United Kingdom",
        )
    ]


def test_missing_values_and_odd_customers(spark, csv):
    path = csv(
        "1,A,,1,2010-01-01 00:00:00,0.001,,",
        "2,A,x,1,2010-01-01 00:00:00,1.005,7.9,x",
        "3,A,x,1,2010-01-01 00:00:00,1,99999999999.0,x",
    )
    got = rows(csv_files.read_lines(spark, path), "invoice_no", "unit_price", "customer_id", "description")
    assert got == [
        ("1", Decimal("0.0010"), None, None),
        ("2", Decimal("1.0050"), 7, "x"),
        ("3", Decimal("1.0000"), None, "x"),
    ]


@pytest.mark.parametrize("multi_line", [True, False])
def test_every_layout_of_a_time(spark, csv, multi_line):
    times = ["2010-01-01T10:00:00", "2010-01-01 10:00", "2010-01-01 10:00:05.5", "2010-01-01", "2010-01-01 10:00:00", "soon"]
    path = csv(*[f"{i},A,x,1,{t},1.00,1.0,x" for i, t in enumerate(times)])
    ten = dt.datetime(2010, 1, 1, 10)
    wanted = [ten, ten, ten + dt.timedelta(seconds=5.5), dt.datetime(2010, 1, 1), ten, None]
    got = sorted((r.invoice_no, r.order_date) for r in csv_files.read_lines(spark, path, multi_line).collect())
    assert [when for _, when in got] == wanted


def test_line_breaks_in_quotes(spark, csv):
    path = csv('1,A,"two\nlines",1,2010-01-01 00:00:00,1.00,1.0,x', "2,B,one,1,2010-01-01 00:00:00,1.00,1.0,x")
    assert rows(csv_files.read_lines(spark, path), "stock_code", "description") == [("A", "two\nlines"), ("B", "one")]


def test_unparsed_rows_are_kept_as_text(spark, csv):
    path = csv("1,A,x,many,2010-01-01 00:00:00,1.00,1.0,x", "2,A,x,1,not a date,1.00,1.0,x", "3,A,x,1,2010-01-01 00:00:00,1.00,1.0,x")
    assert csv_files.read_lines(spark, path).count() == 3
    bad = csv_files.unparsed_rows(spark, path)
    assert [r[0] for r in rows(bad, "corrupt_record")] == [
        "1,A,x,many,2010-01-01 00:00:00,1.00,1.0,x",
        "2,A,x,1,not a date,1.00,1.0,x",
    ]


STORE = Store("jdbc:postgresql://host/db", "me", "secret")


def test_store_options():
    assert "secret" not in repr(STORE)
    plain = read_options(STORE, "fact_orders")
    assert plain["dbtable"] == "fact_orders" and "partitionColumn" not in plain
    split = read_options(STORE, "fact_orders", KeyRange("order_line_id", "1", "1000"))
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"]) == ("order_line_id", "1", "1000")
    assert split["numPartitions"] == "8"
    emptied = jdbc.truncate_options(STORE, "dim_customers")
    assert emptied["truncate"] == "true" and emptied["cascadeTruncate"] == "true"
    assert jdbc.write_options(STORE, "dim_customers")["batchsize"] == "10000"
    counted = count_options(STORE, "dim_customers")
    assert counted["query"] == "SELECT count(*) AS n FROM dim_customers" and "dbtable" not in counted


def test_refresh_empties_children_first_and_loads_parents_first(warehouse_of, monkeypatch):
    from tests.conftest import line

    calls, held = [], {}

    monkeypatch.setattr(jdbc, "truncate", lambda like, store, table: (calls.append(("truncate", table)), held.pop(table, None)))
    monkeypatch.setattr(jdbc, "append", lambda df, store, table: (calls.append(("append", table)), held.update({table: df.count()})))
    monkeypatch.setattr(jdbc, "count_rows", lambda spark, store, table: held[table])
    loaded = jdbc.refresh(warehouse_of([line(), line(invoice="2")]), STORE)
    tables = [
        "dim_customers", "dim_products", "fact_orders", "analytics.revenue_summary",
        "analytics.customer_retention", "analytics.product_performance",
    ]
    assert calls == [("truncate", t) for t in reversed(tables)] + [("append", t) for t in tables]
    assert loaded["fact_orders"] == 2
    monkeypatch.setattr(jdbc, "count_rows", lambda spark, store, table: held[table] + 1)
    with pytest.raises(RuntimeError):
        jdbc.refresh(warehouse_of([line()]), STORE)
