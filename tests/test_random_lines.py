"""Every registered query against its SQL on random lines with all kinds of defects.

The order tables are clean and regular.  These lines have missing values in
every column, prices below a cent, orders shared by customers, odd spellings,
copies, ties, and times on the edges of the date window.  There is no empty
text in them: a CSV file cannot tell it from a missing one.
"""

import random

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver
from cartledger.params import Params
from cartledger.schemas import LINE_SCHEMA
from cartledger.warehouse import Warehouse
from oracle import retail
from tests.conftest import line
from tests.parity import compare

LINES = "SELECT * FROM given_lines"


def some_lines(seed: int, n: int):
    r = random.Random(seed)
    country_of = {c: r.choice([" eire ", "FRANCE", "united  kingdom", "o'neil-x land"]) for c in range(12)}
    made = []
    for _ in range(n):
        customer = r.choice([None, *range(12)])
        made.append(
            line(
                invoice=r.choice([None, " ", "c7"] + [f"{p}{i}" for p in ("", "", "C") for i in range(25)]),
                stock=r.choice([None, " ", "A", "b", "B", "85048", "85048A", "POST"]),
                description=r.choice([None, "  ", "a thing", " A THING", "zEBRA 3d", "unknown"]),
                quantity=r.choice([None, 0, -2, -1, 1, 1, 2, 3, 3, 12]),
                when=r.choice(
                    [None, "2009-11-30 23:59:59", "2009-12-01 00:00:00", "2011-12-31 23:59:59", "2012-01-01 00:00:00"]
                    + [f"{y}-{m:02d}-{d:02d} {h:02d}:30:15" for y in (2010, 2011) for m in (1, 2, 3, 11, 12) for d, h in ((1, 0), (28, 23))]
                ),
                price=r.choice([None, "-1.00", "0", "0.001", "0.005", "1.005", "2.50", "99.99", "310.25"]),
                customer=customer,
                country=r.choice(["france", country_of.get(customer, "x")]) if r.random() < 0.9 else country_of.get(customer, None),
            )
        )
    return made + r.choices(made, k=n // 4)


@pytest.fixture(scope="module", params=[(1, 700), (2, 60)], ids=["many", "few"])
def case(request, spark, lines_of, tmp_path_factory):
    seed, n = request.param
    path = str(tmp_path_factory.mktemp("random") / "lines")
    lines_of(some_lines(seed, n)).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW given_lines AS SELECT * FROM read_parquet('{path}/*.parquet')")
    params = Params()
    lines = spark.read.schema(LINE_SCHEMA).parquet(path)
    assert pq.read_table(path).num_rows == n + n // 4
    return con, Warehouse(lines, params), retail.texts(params, LINES)


@pytest.mark.parametrize("name", driver.builders())
def test_same_rows(case, name):
    con, w, texts = case
    fresh = Warehouse(w.lines, w.params)
    assert compare(con, driver.comparable(driver.builders()[name](fresh)), texts[name]) is None
