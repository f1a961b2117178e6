"""The submit entry point, end to end over files."""

import os

import pytest

from cartledger.__main__ import main
from tests.test_jobs import BAD, GOOD
from tests.test_sources import HEADER


@pytest.fixture
def raw(tmp_path):
    os.makedirs(tmp_path / "raw")
    (tmp_path / "raw" / "a.csv").write_text(HEADER + GOOD.format(1) + BAD.format(2) + GOOD.format(1))
    return str(tmp_path / "raw")


def test_etl_stats_and_report(spark, raw, tmp_path, capsys):
    root = str(tmp_path / "out")
    main(["etl", raw, root])
    told = capsys.readouterr().out
    assert "input_rows: 4" in told and "rejected_rows: 2" in told and "duplicates: 1" in told
    main(["stats", root])
    told = capsys.readouterr().out
    assert "Fact - Orders" in told and "3.00" in told
    main(["report", "revenue_per_country", root])
    assert "Eire" in capsys.readouterr().out
    main(["report", "revenue_per_country", root, "--out", str(tmp_path / "written")])
    assert spark.read.option("header", "true").csv(str(tmp_path / "written")).first()["country"] == "Eire"


def test_a_cut_report_says_so(spark, monkeypatch, capsys):
    from cartledger import __main__ as command

    monkeypatch.setattr(command, "REPORT_ROWS", 3)
    command._show(spark.range(3))
    assert "--out" not in capsys.readouterr().out
    command._show(spark.range(4))
    assert "Only the first 3 rows" in capsys.readouterr().out


def test_ingest_and_rebuild(spark, raw, tmp_path, capsys):
    zone, state, root = (str(tmp_path / n) for n in ("zone", "state", "out"))
    main(["ingest", raw, zone, state])
    main(["rebuild", zone, root])
    assert "valid_rows: 2" in capsys.readouterr().out


def test_unknown_commands_are_refused():
    with pytest.raises(SystemExit):
        main(["upload"])


def test_a_published_zone(spark, tmp_path, capsys):
    root = str(tmp_path / "zone")
    for number in (1, 2):
        (tmp_path / f"{number}.csv").write_text(HEADER + f"{number},A,x,2,2010-01-01 00:00:00,1.50,1.0,eire\n")
        main(["merge", str(tmp_path / f"{number}.csv"), root])
    main(["versions", root])
    main(["report", "total_orders", root])
    main(["vacuum", root, "--keep", "1"])
    out = capsys.readouterr().out
    assert "version: 2" in out and "1: {" in out and "|2 " in out and "deleted: 1" in out
