"""Validation rules, the valid/rejected split, and its counts."""

import pytest
from pyspark.sql import functions as F

from cartledger.operators import extracts, quality
from cartledger.operators.quality import Rule
from cartledger.params import Params
from tests.conftest import line, rows

CASES = {
    # name: (line, rules that fail)
    "plain": (line(), set()),
    "cancelling": (line(invoice="C9", quantity=-12), set()),
    "positive on a cancelling invoice": (line(invoice="C9", quantity=3), set()),
    "free": (line(price="0"), set()),
    "anonymous": (line(customer=None), set()),
    "first moment": (line(when="2009-12-01 00:00:00"), set()),
    "last moment": (line(when="2011-12-31 23:59:59"), set()),
    "too early": (line(when="2009-11-30 23:59:59"), {"date_window"}),
    "too late": (line(when="2012-01-01 00:00:00"), {"date_window"}),
    "no date": (line(when=None), {"date_window"}),
    "no invoice": (line(invoice=None), {"filled_invoice_no_stock_code"}),
    "blank invoice": (line(invoice="  "), {"filled_invoice_no_stock_code"}),
    "no stock code": (line(stock=None), {"filled_invoice_no_stock_code"}),
    "blank stock code": (line(stock=" "), {"filled_invoice_no_stock_code"}),
    "empty stock code": (line(stock=""), {"filled_invoice_no_stock_code"}),
    "zero units": (line(quantity=0), {"quantity"}),
    "zero units cancelled": (line(invoice="C1", quantity=0), {"quantity"}),
    "negative units": (line(quantity=-1), {"quantity"}),
    "lower case mark": (line(invoice="c1", quantity=-1), {"quantity"}),
    "no units": (line(quantity=None), {"quantity"}),
    "negative price": (line(price="-0.01"), {"unit_price"}),
    "no price": (line(price=None), {"unit_price"}),
    "everything wrong": (
        line(invoice=None, quantity=None, price=None, when=None),
        {"filled_invoice_no_stock_code", "quantity", "unit_price", "date_window"},
    ),
    "negative without invoice": (line(invoice=None, quantity=-1), {"filled_invoice_no_stock_code", "quantity"}),
}
RULES = ["filled_invoice_no_stock_code", "quantity", "unit_price", "date_window"]


@pytest.fixture(scope="module")
def orders(lines_of):
    return extracts.orders(lines_of([c[0] for c in CASES.values()]))


def test_flags_of_every_case(lines_of):
    for name, (row, failing) in CASES.items():
        flagged = quality.flagged(extracts.orders(lines_of([row])), quality.default_rules(Params())).first().asDict()
        assert {r for r in RULES if not flagged["is_valid_" + r]} == failing, name
        assert all(flagged["is_valid_" + r] is not None for r in RULES), name


def test_every_row_is_valid_or_rejected(orders):
    rules = quality.default_rules(Params())
    good, bad = quality.valid(orders, rules), quality.rejected(orders, rules)
    assert good.count() == sum(not failing for _, failing in CASES.values())
    assert good.count() + bad.count() == orders.count()
    assert good.columns == orders.columns
    assert bad.columns == orders.columns + ["is_valid_" + r for r in RULES]


def test_summary_counts(orders):
    counts = quality.summary(orders, quality.default_rules(Params())).first().asDict()
    assert counts["input_rows"] == len(CASES)
    assert counts["valid_rows"] + counts["rejected_rows"] == len(CASES)
    for rule in RULES:
        assert counts["failed_" + rule] == sum(rule in failing for _, failing in CASES.values())


def test_own_rules_replace_the_default_ones(warehouse_of):
    w = warehouse_of([line(quantity=5), line(quantity=50)], rules=[Rule("small", F.col("quantity") < 10)])
    assert rows(w.valid_orders, "quantity") == [(5,)]
    assert "is_valid_small" in quality.rejected(w.orders, w.rules).columns


def test_no_rules_keep_everything(orders):
    assert quality.valid(orders, []).count() == orders.count()
    assert quality.rejected(orders, []).count() == 0


def test_rule_names_must_differ(orders):
    twice = [Rule("x", F.lit(True)), Rule("x", F.lit(False))]
    for use in (quality.flagged, quality.valid, quality.rejected, quality.summary):
        with pytest.raises(ValueError):
            use(orders, twice)


def test_window_comes_from_params(warehouse_of):
    w = warehouse_of([line(when="1996-01-01 00:00:00")], Params(window_start="1995-02-01 00:00:00", window_end="2001-06-30 23:59:59"))
    assert w.valid_orders.count() == 1
