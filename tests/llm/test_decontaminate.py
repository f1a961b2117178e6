import random

import pytest

from cartledger.llm import decontaminate
from tests.llm.test_jaccard import shingles

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def found(spark, docs, items, rule=decontaminate.Containment()):
    frame = decontaminate.contained(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), rule=rule)
    return sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in frame.collect()), key=str)


def plain(docs, items, rule=decontaminate.Containment()):
    out = set()
    for d, text in docs:
        held = shingles(text, rule.width)
        for i, item in items:
            own = shingles(item, rule.width)
            if own and 100 * len(held & own) >= rule.percent * len(own):
                out.add((d, i, len(own), len(held & own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent, width", [(75, 5), (50, 3), (100, 4), (30, 1)])
def test_finds_every_item_that_is_contained(spark, percent, width):
    rng = random.Random(percent)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.choice([2, 30, 400]))]
        part = rng.choice(items)[1].split()
        part = part[: max(1, int(len(part) * rng.random() * 1.4))]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = word()
        cut = rng.randrange(len(text))
        docs.append((d, " ".join(text[:cut] + part + text[cut:])))
    rule = decontaminate.Containment(percent=percent, width=width)
    want = plain(docs, items, rule)
    assert want and found(spark, docs, items, rule) == want


def test_nulls_short_items_repeated_rows_and_long_texts(spark):
    item = "One two three four five six seven eight nine ten"
    long = " ".join(f"x{i}" for i in range(50_000))
    docs = [(1, None), (2, ""), (3, f"a b\n{item.upper()}\tc"), (3, f"a b\n{item.upper()}\tc"), (None, item), (4, f"{long} {item} {long}"),
            (5, "two words"), (6, "two words more"), (7, "one two three four five")]
    items = [(1, item), (1, item), (2, None), (3, " "), (4, "Two words"), (None, "two  words")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_clean_documents_stay_as_they_are(spark):
    item = " ".join(f"i{k}" for k in range(20))
    columns = "doc_id long, text string, `row` int, item_id long, shingle string"
    rows = [(1, "clean text", 1, 1, "s"), (1, "clean text", 1, 1, "s"), (2, f"some {item} more", 2, 2, None), (None, None, 3, None, None)]
    frame = spark.createDataFrame(rows, columns)
    kept = decontaminate.decontaminated(frame, spark.createDataFrame([(9, item)], ITEM))
    assert kept.columns == frame.columns and sorted(r["row"] for r in kept.collect()) == [1, 1, 3]
    plans = decontaminate.contained(frame, spark.createDataFrame([(9, item)], ITEM))._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_clashing_columns_do_not_change_what_is_found(spark):
    item = " ".join(f"i{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a {item} b", 7, 3, "x", 2, 9)], DOC + ", item_id long, `row` int, shingle string, n_item int, id int")
    items = spark.createDataFrame([(9, item, 5, "y", 4)], ITEM + ", doc_id long, w string, `row` int")
    (only,) = decontaminate.contained(docs, items).collect()
    assert (only.doc_id, only.item_id, only.n_item, only.n_shared) == (1, 9, 16, 16)
