import hashlib
import random

import numpy as np
import pytest

from cartledger.llm import codes
from cartledger.llm.hot import attached

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows, coding):
    """The contract once more, over every entry."""
    kept = [(i, [min(max(int(np.floor(np.float64(np.float32(x)) * 1024)), -codes.LARGEST), codes.LARGEST) for x in v], label)
            for i, v, label in rows if v and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // coding.parts if kept else 0
    cut = [[v[p * size : (p + 1) * size] for p in range(coding.parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[: coding.entries]] for p in range(coding.parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(coding.rounds):
        for p in range(coding.parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for j, m in members.items():
                books[p][j] = [sum(x) // len(m) for x in zip(*m)]
    found = [[nearest(c[p], books[p]) for p in range(coding.parts)] for c in cut]
    errors = {}
    for (_, _, label), f in zip(kept, found):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, bytes(j for _, j in f), sum(d for d, _ in f), errors[label]) for (i, _, label), f in zip(kept, found)], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, coding, columns=COLUMNS):
    got = codes.compress(spark.createDataFrame(rows, columns), coding)
    mine = [(r.vec_id, bytes(r.code), r.error, r.label_error) for r in got.rows.collect()]
    want, digest = plain([r[:3] for r in rows], coding)
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert codes.digest(got.books) == digest
    return got


@pytest.mark.parametrize("cell", [40, 256, 5000])
def test_matches_evaluating_every_entry(spark, cell):
    pick = random.Random(cell)
    rows = [(i, [pick.gauss(0, 0.3) for _ in range(8)], pick.choice([None, 1, 2])) for i in range(120)]
    rows += [(pick.randrange(500), [pick.choice([-0.5, 0.0, 0.25]) for _ in range(8)], 2) for _ in range(60)]
    got = check(spark, rows, codes.Coding(entries=16, rounds=3, cell=cell, cells=10))
    again = codes.restored(got.rows, got.books).first()
    assert len(again["vector"]) == 8


def test_left_out_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    ok = [0.5, -0.25, 0.125, 1.0]
    rows = [(5, ok, 1), (5, ok, 1), (None, [0.0] * 4, None), (7, None, 1), (8, [0.1, None, 0.1, 0.1], 1), (9, [nan] * 4, 1),
            (1, [inf, 0.0, 0.0, 0.0], 1), (2, [], 1), (3, [-0.0005, 0.0, 3e9, -3e9], None)]
    check(spark, rows, codes.Coding(entries=3))
    check(spark, rows, codes.Coding(entries=256))


def test_other_lengths_empty_table_and_clashing_columns(spark):
    rows = [(1, [0.0] * 4, 1, "x", 1), (2, [0.0] * 8, 1, "x", 2), (3, [0.0] * 5, 1, "x", 3)]
    columns = COLUMNS + ", code string, `_key` int"
    got = codes.compress(spark.createDataFrame(rows, columns))
    assert [r.vec_id for r in got.rows.collect()] == [1]
    assert codes.compress(spark.createDataFrame([], COLUMNS)).rows.collect() == []


def test_tables_beyond_the_bound_are_joined_by_salt(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(90)], "i int, k int")
    table = spark.createDataFrame([(None, "n"), (1, "a")], "k int, v string")
    for bound in (0, 10):
        got = {(r.i, r.v) for r in attached(rows, table, "k", bound).collect()}
        assert got == {(i, ("n", "a", None)[i % 3]) for i in range(90)}
