"""Duplicate removal against a plain Python version of the same definition."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartledger.operators import dedup, extracts
from tests.conftest import line, rows


def expected(order_rows):
    """Split rows (invoice, customer, stock, date, quantity, price) into kept and removed."""
    groups = {}
    for r in order_rows:
        groups.setdefault((r[0], r[2], r[3], r[4]), []).append(r)
    kept, removed = [], []
    for group in groups.values():
        first, *rest = sorted(group, key=lambda r: (r[1] is None, r[1] or 0, r[5]))
        kept.append(first)
        removed.extend(rest)
    return Counter(kept), Counter(removed)


def check(lines):
    orders = extracts.orders(lines)
    kept, removed = expected([tuple(r) for r in orders.collect()])
    assert Counter(tuple(r) for r in dedup.unique_lines(orders).collect()) == kept
    assert Counter(tuple(r) for r in dedup.removed_lines(orders).collect()) == removed


def test_choice_within_a_group(lines_of):
    check(
        lines_of(
            [
                line(customer=None, price="1.00"),
                line(customer=7, price="2.00"),
                line(customer=7, price="1.50"),
                line(customer=7, price="1.50"),
                line(customer=9, price="0.10"),
                line(quantity=2),
                line(stock="B"),
            ]
        )
    )


def test_nulls_in_the_key_are_one_group(lines_of):
    check(lines_of([line(invoice=None, when=None, quantity=None)] * 3))


lines_strategy = st.lists(
    st.builds(
        line,
        invoice=st.sampled_from(["1", "C2"]),
        stock=st.sampled_from(["A", "B"]),
        quantity=st.sampled_from([1, 2]),
        price=st.sampled_from(["1.00", "2.00"]),
        customer=st.sampled_from([None, 1, 2]),
    ),
    max_size=30,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines_strategy)
def test_any_lines(lines_of, some):
    check(lines_of(some))


def test_many_copies_of_one_line_are_written_out_in_chunks(lines_of, monkeypatch):
    monkeypatch.setattr(dedup, "_COPIES_PER_CHUNK", 10)
    orders = extracts.orders(lines_of([line()] * 95 + [line(customer=2)] * 21))
    removed = dedup.removed_lines(orders)
    assert removed.count() == 115
    assert rows(removed.groupBy("customer_id").count()) == [(1, 94), (2, 21)]


def test_result_does_not_depend_on_order_or_partitions(lines_of):
    some = [line(invoice=str(i % 7), customer=i % 3 or None, price=f"{i % 5}.00") for i in range(200)]
    base = rows(dedup.unique_lines(extracts.orders(lines_of(some))))
    for n, order in ((1, list(reversed(some))), (13, some)):
        assert rows(dedup.unique_lines(extracts.orders(lines_of(order).repartition(n)))) == base
