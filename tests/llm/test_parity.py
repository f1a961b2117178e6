"""Queries over documents against their SQL."""

import os

import pytest

from cartledger.llm import queries
from tests.parity import compare, connect

FOLDER = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows(spark, name):
    assert compare(connect(FOLDER), queries.queries()[name](spark, FOLDER), queries.oracle_sql()[name]) is None
