"""CSV files read range by range against Spark's own reader, which takes a file whole."""

import random

import pytest
from pyspark.sql import functions as F

from cartledger.sources import csv_files, csv_ranges
from tests.conftest import rows
from tests.test_sources import HEADER


@pytest.fixture
def ranges_of(spark):
    """Let a file's ranges be of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_to
    for name, value in before.items():
        spark.conf.set(name, value)


def record(pick):
    """A record as a writer would write it, or with quotes inside unquoted fields."""
    def field():
        kind = pick.randrange(6)
        plain = "".join(pick.choice("ab é") for _ in range(pick.randrange(6)))
        if kind == 0:
            return '"' + "".join(pick.choice(["x", "\n", '""', ",", "\r\n", "\n\n"]) for _ in range(pick.randrange(12))) + '"'
        return plain + ('"' if kind == 1 and plain else "") + ("" if kind != 2 else "z")

    return f"{field()}x,{field()},{field()},{pick.choice(['1', '-2', 'no', ''])},2010-01-01 00:00:00,1.5,3.0,{field()}"


def same(spark, folder):
    want = rows(csv_files.read_raw(spark, folder))
    got = rows(csv_ranges.read_raw(spark, folder))
    assert got == want
    return want


@pytest.mark.parametrize("size", [7, 40, 300, 100_000])
def test_same_rows_as_whole_files(spark, ranges_of, tmp_path, size):
    pick = random.Random(size)
    for name in "abc":
        text = HEADER + "\n".join(record(pick) for _ in range(60)) + pick.choice(["", "\n", "\n\n"])
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    ranges_of(size)
    assert len(same(spark, str(tmp_path))) == 180


def test_a_field_over_many_ranges(spark, ranges_of, tmp_path):
    long = '"' + "a line, with commas\n" * 50 + '""end"""'
    (tmp_path / "a.csv").write_text(HEADER + f"1,A,{long},2,2010-01-01 00:00:00,1.50,1.0,eire\n2,B,x,2,2010-01-01 00:00:00,1.50,1.0,eire\n")
    ranges_of(30)
    assert len(same(spark, str(tmp_path))) == 2
    opened = csv_ranges.ranges(spark, str(tmp_path)).where("begins_open")
    assert opened.count() > 20


def test_headers_and_empty_files(spark, ranges_of, tmp_path):
    (tmp_path / "only.csv").write_text(HEADER)
    (tmp_path / "nothing.csv").write_text("")
    (tmp_path / "wide.csv").write_text('"In\nvoice",StockCode,Description,Quantity,InvoiceDate,Price,"Customer\n\nID",Country\n1,A,x,2,2010-01-01 00:00:00,1.50,1.0,eire')
    for size in (5, 1000):
        ranges_of(size)
        assert [r[0] for r in rows(csv_ranges.read_raw(spark, str(tmp_path)))] == ["1"]


def test_a_file_is_read_by_several_tasks(spark, ranges_of, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,A,x,2,2010-01-01 00:00:00,1.50,1.0,eire\n" * 500)
    ranges_of(2000)
    tasks = csv_ranges.records(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
    assert tasks > 5


def test_beyond_the_broadcast_bound(spark, ranges_of, tmp_path, monkeypatch):
    pick = random.Random(1)
    (tmp_path / "a.csv").write_bytes((HEADER + "\n".join(record(pick) for _ in range(80))).encode())
    ranges_of(50)
    monkeypatch.setattr(csv_ranges, "BROADCAST_RANGES", -1)
    same(spark, str(tmp_path))
