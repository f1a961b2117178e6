import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cartledger.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf(doc, text, lang, source, n_chars):
    parts = [doc, source, lang, n_chars, text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def grown(nodes):
    """The node that is left and, for each node, its steps (place, siblings) on the way to it."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 16, len(nodes))) for i in range(0, len(nodes), 16)]
        for run in runs:
            for at in run:
                siblings = "".join(nodes[j] for j in run if j != at)
                for i in groups[at]:
                    paths[i].append((at - run[0], siblings))
        groups = [[i for at in run for i in groups[at]] for run in runs]
        nodes = [h("".join(nodes[at] for at in run)) for run in runs]
    return nodes[0], paths


def tampered(row):
    if row[0] is None or row[1] is None or zlib.crc32(str(row[0]).encode()) % 5:
        return row
    return (row[0], row[1].translate({c: c + 32 for c in range(65, 91)}), *row[2:])


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((own, *grown([leaf(*r) for r in own])))
    root, upper = grown([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for row, path in zip(own, paths):
            steps = path + above
            out.append((row[0], leaf(*row), subroot, h("".join(s for _, s in steps)), merkle.folded(leaf(*tampered(row)), steps)))
    return root, out


def found(spark, rows, columns=COLUMNS, **settings):
    frame = spark.createDataFrame(rows, columns)
    suspect = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(frame, suspect, {"text": text}, **settings)


def check(spark, rows, columns=COLUMNS):
    got = found(spark, rows, columns)
    root, want = plain([r[:5] for r in rows])
    assert got.root == root
    assert sorted(map(tuple, got.leaves.collect()), key=str) == sorted(want, key=str)
    return got


def test_many_sources_and_a_hot_one(spark):
    rows = [(i, f"Text {i}" if i % 3 else f"plain {i}", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(900)]
    got = check(spark, rows)
    bad = got.leaves.where(F.col("folded_root") != got.root)
    assert {r.doc_id for r in bad.collect()} == {r[0] for r in rows if tampered(r) != r}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_of_one_source(spark, n):
    check(spark, [(i, "a", None, "x", 1) for i in range(n)])


def test_nulls_empty_and_long_texts_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (1, "Ä" * 200_000, "de", None, 5), (1, "Ä" * 200_000, "de", None, 5)]
    rows += [(1, "B", "en", "é", 2), (1, "A", "en", "é", 2), (-7, "Z", "en", "z", 2), (5, "Q", None, "", None)]
    check(spark, rows)


def test_proofs_lead_to_the_root(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 2}", i) for i in range(40)]
    got = found(spark, rows, with_proofs=True)
    for r in got.leaves.collect():
        steps = [(s.slot, s.siblings) for s in r.proof]
        assert merkle.folded(r.leaf, steps) == got.root
        assert h("".join(s for _, s in steps)) == r.proof_sha256


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []).leaves.collect() == []
    columns = COLUMNS + ", tree int, pos int, digest string, `group` string, id int"
    check(spark, [(i, "x", "en", "s", 1, 9, 9, "d", "g", 3) for i in range(20)], columns)
