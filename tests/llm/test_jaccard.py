import random
from itertools import combinations

import pytest

from cartledger.llm import jaccard
from cartledger.llm.components import components

COLUMNS = "doc_id long, text string"


def shingles(text, width):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x.decode() for x in lowered.encode().split()]
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def plain(rows, rule):
    sets = [shingles(t, rule.width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= rule.percent * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[root(i)] = min(first.get(root(i), doc), doc)
    return [(rows[i][0], len(sets[i]), first.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def found(spark, rows, rule, columns=COLUMNS):
    frame = jaccard.near_duplicates(spark.createDataFrame(rows, columns), rule=rule)
    return [tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()]


def family(rng, size, copies, edits):
    """Copies of one text, each with a few words replaced."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield text


@pytest.mark.parametrize("frequent", [2, 16])
def test_all_links_of_random_families(spark, frequent):
    rng = random.Random(7)
    boiler = [f"b{i}" for i in range(40)]
    texts = []
    for size, copies, edits in ((8, 30, 1), (30, 40, 3), (60, 40, 4), (200, 30, 12), (12, 12, 1)):
        for text in family(rng, size, copies, edits):
            texts.append(" ".join(text if rng.random() < 0.7 else boiler + text))
    for n in range(1, 9):  # small sets, and sets made of boilerplate alone
        texts += [" ".join(boiler[i : i + n]) for i in range(6)] + [" ".join(boiler[: 20 + n])] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rule = jaccard.Similarity(frequent=frequent)
    assert sorted(found(spark, rows, rule)) == sorted(plain(rows, rule))


@pytest.mark.parametrize("share", [90, 240])
def test_a_passage_that_a_third_shares(spark, share, monkeypatch):
    """Sets that have only the passage in common are not compared with each other."""
    rng = random.Random(share)
    passage = [f"p{i}" for i in range(share)]
    texts = [passage + [f"o{rng.randrange(10**7)}" for _ in range(rng.randrange(80, 260))] for _ in range(60)]
    texts += [list(t) + ["end"] for t in texts[:6]] + [[f"u{rng.randrange(10**7)}" for _ in range(100)] for _ in range(120)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    met = []
    by_rarest = jaccard._by_rarest

    def counted(*args):
        pairs = by_rarest(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_by_rarest", counted)
    rule = jaccard.Similarity(frequent=2, dealt=16)
    assert sorted(found(spark, rows, rule)) == sorted(plain(rows, rule))
    if share == 90:
        assert sum(met) <= 6


@pytest.mark.parametrize("percent, width", [(50, 3), (90, 1), (60, 2)])
def test_other_similarities(spark, percent, width):
    rng = random.Random(percent)
    rows = [(i, " ".join(f"v{rng.randrange(14)}" for _ in range(rng.randrange(1, 16)))) for i in range(150)]
    rule = jaccard.Similarity(percent=percent, width=width, frequent=4)
    assert sorted(found(spark, rows, rule)) == sorted(plain(rows, rule))


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (5, "a B"), (None, "a b"), (None, "only here now"),
            (7, long), (8, long + " end"), (9, long.upper()), (10, "É b"), (11, "é b")]
    rule = jaccard.Similarity()
    assert sorted(found(spark, rows, rule), key=str) == sorted(plain(rows, rule), key=str)
    assert found(spark, [], rule) == []


def test_one_of_each_group_stays(spark):
    columns = "doc_id long, text string, `_row` int, component string"
    rows = [(3, "a b c", 1, "x"), (1, "A b c", 2, "y"), (1, "A b c", 2, "y"), (4, "", 3, None), (5, None, 4, None), (6, None, 5, None),
            (None, "lonely", 6, None), (None, "lonely", 6, None), (8, "other text", 7, None)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, columns))
    assert kept.columns == ["doc_id", "text", "_row", "component"]
    assert sorted(r["_row"] for r in kept.collect()) == [2, 3, 4, 5, 6, 7]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250)]
    random.Random(1).shuffle(edges)
    labels = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert labels == {i: 0 for i in range(101)} | {200: 200, 250: 200, 300: 200}
