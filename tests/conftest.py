import datetime as dt
from decimal import Decimal

import pytest

from cartledger.params import Params
from cartledger.schemas import LINE_SCHEMA
from cartledger.session import local_session
from cartledger.warehouse import Warehouse


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = local_session(
        4,
        app="cartledger-tests",
        shuffle_partitions=4,
        driver_memory="3g",
        **{
            "spark.checkpoint.dir": str(base / "shared"),
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.sql.catalogImplementation": "in-memory",
            "spark.sql.maxMetadataStringLength": "10000",
        },
    )
    yield session
    session.stop()


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def line(invoice="1", stock="A", quantity=1, when="2010-05-01 10:00:00", price="1.00", customer=1,
         country="united kingdom", description="a thing"):
    return (
        invoice,
        stock,
        description,
        quantity,
        None if when is None else moment(when),
        None if price is None else Decimal(price),
        customer,
        country,
    )


@pytest.fixture(scope="session")
def lines_of(spark):
    return lambda rows: spark.createDataFrame(rows, LINE_SCHEMA)


@pytest.fixture(scope="session")
def warehouse_of(lines_of):
    return lambda rows, params=Params(), **kw: Warehouse(lines_of(rows), params, **kw)


def rows(df, *columns):
    """Rows as a sorted list of plain tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((x is None, x) for x in t))
