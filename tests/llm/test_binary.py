import math
import random
from itertools import combinations

import numpy as np
import pytest

from cartledger.llm import binary

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.98):
    """Every pair of a label."""
    vectors = [None if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, np.float32).astype(float) for _, v, _ in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = vectors[i], vectors[j]
        if a is None or b is None or rows[i][2] is None or rows[i][2] != rows[j][2] or len(a) != len(b):
            continue
        if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
            degree[i] += 1
            degree[j] += 1
            parent[root(j)] = root(i)
    first = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            first[root(i)] = min(first.get(root(i), doc), doc)
    return [(r[0], degree[i], first.get(root(i))) for i, r in enumerate(rows)]


def check(spark, rows, columns=COLUMNS, rule=binary.Near()):
    got = [tuple(r) for r in binary.near_duplicates(spark.createDataFrame(rows, columns), rule).collect()]
    want = plain([r[:3] for r in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def around(pick, centre, spread):
    return [float(c + pick.gauss(0, spread)) for c in centre]


def noisy(seed, width, n=500, spread=0.1):
    """Groups of near copies about the similarity, and vectors of their own."""
    pick, rows = random.Random(seed), []
    centres = [[pick.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    for i in range(n):
        kind = i % 12
        vector = around(pick, centres[kind], spread * (1 + kind / 6)) if kind < 6 else [pick.gauss(0, 1) for _ in range(width)]
        rows.append((i * 7 % 1009, vector, pick.choice([1, 1, 2])))
    return rows


@pytest.mark.parametrize("width", [3, 24, 64, 100])
def test_finds_every_link(spark, width):
    want = check(spark, noisy(width, width))
    assert sum(n for _, n, _ in want) > 50


def test_few_probes_and_shared_buckets_lose_nothing(spark):
    check(spark, noisy(5, 32, 300), rule=binary.Near(probes=3, bucket=8))


def test_vectors_about_one_direction(spark):
    pick = random.Random(9)
    rows = [(i, [5.0] + [pick.gauss(0, 0.3) for _ in range(15)], 1) for i in range(200)]
    check(spark, rows)


def test_unusable_vectors_copies_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [2.0, -0.0], 1), (None, [3.0, 0.1], 1), (None, [0.0, 1.0], 3), (None, None, None),
            (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [3e38, 1.0], 2), (13, [1e-38, 0.0], 2)]
    check(spark, rows)


def test_a_third_of_the_rows_are_copies(spark):
    rows = noisy(3, 16, 200) + [(2000 + i, [0.5] * 16, 1) for i in range(100)]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    check(spark, [])
    rows = [(i, [1.0, i % 2 * 0.1], 1, 5, "k", True) for i in range(6)]
    check(spark, rows, COLUMNS + ", id int, key string, notable boolean")


def test_flips_are_all_sets_within_the_budget():
    cost = np.random.default_rng(1).random((20, 7)) ** 2
    owner, mask, many = binary.flips(cost, 0.3, 1000)
    want = {(r, m) for r in range(20) for m in range(128) if sum(cost[r, b] for b in range(7) if m >> b & 1) <= 0.3}
    assert len(owner) == len(want) and set(zip(owner.tolist(), mask.tolist())) == want and not many.any()
