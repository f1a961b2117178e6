"""Large steps of the jobs are done once: lines are computed, merged and gathered no more often than needed."""

import pytest
from pyspark.sql import functions as F

from cartledger.operators import dedup
from cartledger.plans import audit, incremental, jobs
from cartledger.sinks import snapshots
from cartledger.streaming import arrivals
from cartledger.warehouse import Warehouse
from tests.conftest import line, rows

SOME = [
    line(invoice=str(i), stock=f"S{i % 5}", customer=i % 4 or None, price=f"{i}.00", when=f"2010-{i % 3 + 1:02d}-10 08:00:00")
    for i in range(1, 25)
]


@pytest.fixture
def counted(spark, lines_of):
    """A warehouse, and how many of its lines have been computed so far."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(text):
        seen.add(1)
        return text

    return Warehouse(lines_of(SOME).withColumn("country", same(F.col("country")))), seen


def test_followed_files_compute_their_lines_once(counted):
    w, seen = counted
    assert rows(jobs.followed_files(w))
    assert seen.value == len(SOME)


def test_file_arrivals_compute_their_lines_once(counted):
    w, seen = counted
    assert rows(jobs.file_arrivals(w))
    assert seen.value == len(SOME)


def test_curated_tables_compute_their_lines_once(counted):
    w, seen = counted
    assert rows(jobs.curated_tables(w))
    assert seen.value == len(SOME)


def test_audited_tables_compute_their_lines_once(counted):
    w, seen = counted
    assert rows(audit.constraint_audit(w.stored().get))
    assert seen.value == len(SOME)


def test_cells_made_anew_are_not_merged_with_the_batch_again(spark, lines_of, warehouse_of, tmp_path, monkeypatch):
    raw, arrived, root = (str(tmp_path / name) for name in ("raw", "arrived", "zone"))
    w, merges = warehouse_of(SOME), []
    jobs._land(w, lines_of(SOME).withColumn("quantity", F.col("quantity") + 1), raw, "a")
    arrivals.take_in_files(spark, raw, arrived)
    incremental.follow(spark, arrived, root)
    jobs._land(w, lines_of(SOME), raw, "a")
    arrivals.take_in_files(spark, raw, arrived)
    merged = dedup.merged_lines
    monkeypatch.setattr(dedup, "merged_lines", lambda old, new: merges.append(new.count()) or merged(old, new))
    followed = incremental.SnapshotWarehouse(incremental.follow(spark, arrived, root))
    assert sum(merges) < len(SOME)  # withdrawn lines lie in other cells of the same months
    assert rows(followed.fact) == rows(w.fact)


def test_a_merge_writes_its_lines_once(spark, lines_of, tmp_path, monkeypatch):
    staged, table = [], incremental.StageArea.table
    monkeypatch.setattr(incremental.StageArea, "table", lambda self, df, label: staged.append(label) or table(self, df, label))
    first = incremental.take_in(spark, str(tmp_path), lines_of(SOME[:12]))
    second = incremental.take_in(spark, str(tmp_path), lines_of(SOME))
    again = incremental.take_in(spark, str(tmp_path), lines_of(SOME))
    assert not {"arriving", "merged"} & set(staged)
    assert second.cells["fact_orders"] != first.cells["fact_orders"]
    assert again.cells["fact_orders"] == second.cells["fact_orders"]
    folders = {uri.rsplit("=", 1)[1] for uri, _ in snapshots.Files(spark, str(tmp_path)).found(f"{tmp_path}/fact_orders/*/*/commit=*")}
    assert folders == {*first.cells["fact_orders"].values(), *second.cells["fact_orders"].values()}


def test_lines_taken_in_are_not_gathered(spark, lines_of, warehouse_of, tmp_path, monkeypatch):
    plans, w, write = [], warehouse_of(SOME), snapshots.Commit.write

    def noted(self, table, df, *args, **kwargs):
        if table == arrivals.LINES:
            plans.append(kwargs.get("gather", True))
        write(self, table, df, *args, **kwargs)

    monkeypatch.setattr(snapshots.Commit, "write", noted)
    jobs._land(w, lines_of(SOME), str(tmp_path / "raw"), "a")
    snapshot = arrivals.take_in_files(spark, str(tmp_path / "raw"), str(tmp_path / "zone"))
    assert plans == [False]
    assert rows(arrivals.live_lines(snapshot)) == rows(w.lines)
