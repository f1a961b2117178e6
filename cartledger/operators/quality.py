"""Row validation by a list of rules.

A rule is a name and a boolean Column.  A rule that evaluates to null (a null
quantity, price or date) has failed, so every input row is either valid or
rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartledger.functions.text import is_filled
from cartledger.params import Params

FLAG = "is_valid_"

# Fixed value: the first letter that marks a cancelling invoice.
CANCEL_MARK = "C"


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Column

    @property
    def flag(self) -> str:
        return FLAG + self.name


def is_cancelling(invoice: Column) -> Column:
    return F.startswith(invoice, F.lit(CANCEL_MARK))


def filled_rule(*columns: str) -> Rule:
    return Rule("filled_" + "_".join(columns), reduce(and_, (is_filled(F.col(c)) for c in columns)))


def quantity_rule(quantity: str = "quantity", invoice: str = "invoice_no") -> Rule:
    """Sales are positive; only a cancelling invoice may take units back."""
    units = F.col(quantity)
    return Rule("quantity", (units > 0) | ((units < 0) & is_cancelling(F.col(invoice))))


def price_rule(unit_price: str = "unit_price") -> Rule:
    return Rule("unit_price", F.col(unit_price) >= 0)


def window_rule(start: str, end: str, moment: str = "order_date") -> Rule:
    edges = [F.lit(edge).cast("timestamp_ntz") for edge in (start, end)]
    return Rule("date_window", F.col(moment).between(*edges))


def default_rules(params: Params) -> list[Rule]:
    return [
        filled_rule("invoice_no", "stock_code"),
        quantity_rule(),
        price_rule(),
        window_rule(params.window_start, params.window_end),
    ]


def _check_names(rules: Sequence[Rule]) -> None:
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError(f"rule names must differ: {names}")


def _passed(rule: Rule) -> Column:
    return F.coalesce(rule.holds, F.lit(False))


def flagged(orders: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One non-null boolean column per rule next to the order columns."""
    _check_names(rules)
    return orders.select("*", *[_passed(r).alias(r.flag) for r in rules])


def valid(orders: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that pass every rule.

    The bare predicates go to the filter (which drops nulls itself), so those
    on stored columns reach the scan.
    """
    _check_names(rules)
    return reduce(lambda df, rule: df.where(rule.holds), rules, orders)


def rejected(orders: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that fail at least one rule, with the flags that say which."""
    everything = reduce(and_, (F.col(r.flag) for r in rules), F.lit(True))
    return flagged(orders, rules).where(~everything)


def summary(orders: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: input, valid, rejected, and failures per rule.

    A query of its own rather than metrics observed on another one's pass:
    observed counts include the rows of tasks that ran again.
    """
    _check_names(rules)
    everything = reduce(and_, (_passed(r) for r in rules), F.lit(True))
    return orders.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(everything).alias("valid_rows"),
        F.count_if(~everything).alias("rejected_rows"),
        *[F.count_if(~_passed(r)).alias(f"failed_{r.name}") for r in rules],
    )
