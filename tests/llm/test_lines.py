from collections import Counter

from cartledger.llm import lines

COLUMNS = "doc_id long, text string"


def left(spark, rows, columns=COLUMNS, **settings):
    result = lines.dedupe(spark.createDataFrame(rows, columns), **settings)
    return result, [(r["doc_id"], *r["lines"]) for r in result.collect()]


def plain(rows, min_docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = Counter(k for _, ls in split for k in {key(s) for s in ls})
    kept = [(i, ls, [s for s in ls if not key(s) or held[key(s)] < min_docs]) for i, ls in split]
    return [(i, len(ls), len(ls) - len(k), "\n".join(k)) for i, ls, k in kept]


def test_matches_plain_counting(spark):
    rows = [(i, f"Common {i % 3}\nown {i}\n\n  COMMON {i % 7}\t\nÉtat {i % 2}\nétat") for i in range(40)]
    rows += [(None, "common 1"), (7, "Common 1 "), (50, None), (51, ""), (52, "\n\n")]
    for min_docs in (2, 8, 10):
        _, got = left(spark, rows, min_docs=min_docs)
        assert sorted(got, key=str) == sorted(plain(rows, min_docs), key=str)


def test_one_document_keeps_the_line(spark):
    rows = [(i, f"shared\nown {i}") for i in range(12)] + [(None, "shared"), (None, "nameless")] + [(None, "nameless")] * 9
    _, got = left(spark, rows, keep_first=True)
    assert sum("shared" in r[3].split("\n") for r in got) == 1
    assert [r[3] for r in got if r[0] is None].count("nameless") == 10


def test_batches_and_runs_do_not_change_the_counts(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 13))) for i in range(60)]
    want = None
    for batches, fanout in ((1, 2), (5, 2), (8, 3)):
        frame = spark.createDataFrame(rows, COLUMNS)
        counted = frame.selectExpr("explode(split(text, '\n')) AS k", f"doc_id % {batches} AS batch", "doc_id")
        runs = lines.LineRuns(spark, 10, fanout)
        for b in range(batches):
            part = counted.where(f"batch = {b}").selectExpr("xxhash64(k) AS h1", "hash(k) AS h2", "doc_id")
            runs.add(part.groupBy("h1", "h2").agg({"*": "count", "doc_id": "min"}).toDF("h1", "h2", "docs", "first_doc"))
        got = {(r.h1, r.h2) for r in runs.frequent().collect()}
        want = want or got
        assert got == want and len(got) == 10
        assert all(len(level) < fanout for level in runs.levels)


def test_long_text_empty_table_and_clashing_columns(spark):
    long = "\n".join(f"row {i}" for i in range(20_000))
    rows = [(i, long + f"\nend {i}", "x", 1) for i in range(10)]
    frame, got = left(spark, rows, "doc_id long, text string, lines string, `_row` int")
    assert frame.columns == ["doc_id", "text", "lines", "_row"]
    assert sorted(r[3] for r in got) == sorted(f"end {i}" for i in range(10))
    assert left(spark, [], COLUMNS)[1] == []


def test_empty_table_when_one_document_keeps_a_line(spark):
    assert left(spark, [], keep_first=True)[1] == []
    assert left(spark, [(1, None), (None, "")], keep_first=True)[1] == [(1, 1, 0, ""), (None, 1, 0, "")]
