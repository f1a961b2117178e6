"""Files taken in by content."""

import os

import pytest

from cartledger.__main__ import main
from cartledger.plans import incremental
from cartledger.sinks import snapshots
from cartledger.sinks.snapshots import Zone
from cartledger.streaming import arrivals
from cartledger.warehouse import Warehouse
from tests.conftest import rows
from tests.test_incremental import check
from tests.test_sources import HEADER

LINE = "{0},A,x,{1},2010-01-01 00:00:00,1.50,1.0,eire\n"
WIDE = "{0},{1},{2},{3},2010-0{4}-01 00:00:00,1.50,{5},{6}\n"


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        raw, zone = str(tmp_path / "raw"), str(tmp_path / "zone")
        age = 0

        def drop(self, name, *lines):
            path = os.path.join(self.raw, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(HEADER + "".join(LINE.format(*x) for x in lines))
            self.age += 10
            os.utime(path, (1_600_000_000 + self.age,) * 2)

        def take_in(self):
            snapshot = arrivals.take_in_files(spark, self.raw, self.zone)
            return snapshot.version, rows(arrivals.live_lines(snapshot), "invoice_no", "quantity")

    os.makedirs(tmp_path / "raw")
    return Place()


def test_sent_again_renamed_and_replaced(place):
    place.drop("a.csv", ("1", 1), ("2", 2))
    place.drop("2011/b c.csv", ("3", 3))
    place.drop("notes.txt", ("9", 9))
    assert place.take_in() == (1, [("1", 1), ("2", 2), ("3", 3)])
    assert place.take_in()[0] == 1  # nothing new
    place.drop("a again.csv", ("1", 1), ("2", 2))
    os.rename(f"{place.raw}/2011/b c.csv", f"{place.raw}/moved.csv")
    assert place.take_in() == (2, [("1", 1), ("2", 2), ("3", 3)])
    place.drop("a again.csv", ("1", 5), ("2", 2))  # a.csv still has the old content
    assert place.take_in()[1] == [("1", 1), ("1", 5), ("2", 2), ("2", 2), ("3", 3)]
    place.drop("a.csv", ("1", 5), ("2", 2))
    assert place.take_in()[1] == [("1", 5), ("2", 2), ("3", 3)]
    place.drop("a.csv", ("7", 7))
    place.drop("a again.csv", ("7", 7))
    assert place.take_in()[1] == [("3", 3), ("7", 7)]


def test_two_new_files_of_one_content_and_empty_ones(place):
    for name in ("x.csv", "y.csv"):
        place.drop(name, ("1", 1))
    place.drop("header.csv")
    open(f"{place.raw}/empty.csv", "w").close()
    assert place.take_in() == (1, [("1", 1)])
    place.drop("x.csv")
    assert place.take_in()[1] == [("1", 1)]
    place.drop("y.csv")
    assert place.take_in()[1] == []


def test_an_empty_folder(place):
    assert place.take_in() == (1, [])


def test_touched_files_are_not_loaded_again(place):
    place.drop("a.csv", ("1", 1))
    place.take_in()
    place.drop("a.csv", ("1", 1))
    assert place.take_in() == (2, [("1", 1)])


def test_lines_repeated_in_a_file_all_count(place):
    place.drop("a.csv", ("1", 1), ("1", 1), ("1", 1))
    assert place.take_in()[1] == [("1", 1)] * 3
    place.drop("a.csv", ("1", 1), ("1", 1))
    assert place.take_in()[1] == [("1", 1)] * 2


def test_a_run_that_dies_has_taken_in_nothing(spark, place, monkeypatch):
    place.drop("a.csv", ("1", 1))
    place.take_in()
    place.drop("a.csv", ("2", 2))
    write = snapshots.Commit.write

    def dies(self, table, *args, **kwargs):
        write(self, table, *args, **kwargs)
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshots.Commit, "write", dies)
    with pytest.raises(RuntimeError, match="killed"):
        place.take_in()
    monkeypatch.undo()
    assert rows(arrivals.live_lines(Zone(spark, place.zone).latest()), "invoice_no") == [("1",)]
    assert place.take_in() == (2, [("2", 2)])


def test_commands(spark, place, tmp_path, capsys):
    place.drop("a.csv", ("1", 2))
    main(["arrive", place.raw, place.zone])
    main(["rebuild", place.zone, str(tmp_path / "out")])
    main(["follow", place.zone, str(tmp_path / "curated")])
    out = capsys.readouterr().out
    assert out.count("version: 1") == 2 and "valid_rows: 1" in out


def test_a_zone_follows_its_files(spark, place, tmp_path):
    """After each step all tables are those of one run over the lines that count."""
    root = str(tmp_path / "curated")

    def land(name, *lines):
        place.drop(name)
        with open(os.path.join(place.raw, name), "a") as f:
            f.write("".join(WIDE.format(*x) for x in lines))

    def follow():
        arrived = arrivals.take_in_files(spark, place.raw, place.zone)
        snapshot = incremental.follow(spark, place.zone, root)
        check(incremental.SnapshotWarehouse(snapshot), Warehouse(arrivals.live_lines(arrived)).stored())
        return snapshot

    land("a.csv", (1, "A", "old name", 1, 1, 1, "eire"), (2, "B", "zzz", 1, 1, 2, "spain"), ("C3", "B", "b", -1, 2, 1, "eire"))
    land("b.csv", (4, "A", "a", 2, 3, 3, "eire"))
    first = follow()
    land("a.csv", (1, "A", "a", 1, 1, 1, "eire"), (5, "C", "c", 1, 2, 1, "cuba"))  # B, and customer 2, are gone
    land("c.csv", (6, "A", "a", 2, 4, 3, "malta"))
    assert follow().version == first.version + 1
    land("b.csv", (1, "A", "a", 1, 1, 1, "eire"))  # a line that another file has as well
    follow()
    land("b.csv")
    last = follow()
    assert incremental.follow(spark, place.zone, root).version == last.version
    untouched = "year_month=2010-04"
    assert first.cells["fact_orders"].keys() != last.cells["fact_orders"].keys()
    assert any(c.startswith(untouched) for c in last.cells["fact_orders"])


def test_a_zone_catches_up_over_several_versions(spark, place, tmp_path):
    for n in range(3):
        place.drop("a.csv", (str(n), n + 1))
        place.drop(f"{n}.csv", (f"x{n}", 1))
        if n != 1:
            arrived = arrivals.take_in_files(spark, place.raw, place.zone)
            snapshot = incremental.follow(spark, place.zone, str(tmp_path / "curated"))
        else:
            arrivals.take_in_files(spark, place.raw, place.zone)
    check(incremental.SnapshotWarehouse(snapshot), Warehouse(arrivals.live_lines(arrived)).stored())
    assert snapshot.version == 2 and snapshot.info["lines_version"] == 3
