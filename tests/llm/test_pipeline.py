"""Every stage on its predecessor's rows, held against plain Python; then the whole run."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cartledger.llm import jaccard, queries
from cartledger.llm.session import staged
from tests.llm.test_bpe import expected
from tests.llm.test_decontaminate import plain as leaks
from tests.llm.test_jaccard import plain as components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = staged(stage(spark, docs, FOLDER), name)
        assert name == "bpe_encoding" or docs.columns == columns
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_quality_keeps_what_the_query_keeps(spark, stages):
    kept = {r.doc_id for r in queries.op6_quality_rules(spark, FOLDER).where("kept").collect()}
    assert set(texts(stages[1])) == kept and len(kept) < len(stages[0])
    assert all(r.n_chars == len(r.text) for r in stages[1])


def test_frequent_lines_stay_in_one_document(stages):
    before, after = texts(stages[1]), texts(stages[2])
    held = Counter(k for t in before.values() for k in {key(s) for s in t.split("\n")} if k)
    often = {k for k, n in held.items() if n >= 10}
    left = Counter(k for t in after.values() for k in {key(s) for s in t.split("\n")} if k in often)
    assert often and left == Counter(often)
    for i, text in before.items():
        others = [s for s in text.split("\n") if key(s) not in often]
        if i in after:
            assert [s for s in after[i].split("\n") if key(s) not in often] == (others or after[i].split("\n")[:0])
        else:
            assert not "".join(others).split()


def test_one_document_of_each_group_stays(stages):
    rows = list(texts(stages[2]).items())
    assert sorted(texts(stages[3])) == sorted(i for i, _, c in components(rows, jaccard.Similarity()) if i == c)
    assert len(stages[3]) < len(stages[2])


def test_documents_with_benchmark_items_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    found = {d for d, *_ in leaks(list(texts(stages[3]).items()), items)}
    assert sorted(texts(stages[4])) == sorted(set(texts(stages[3])) - found)


def test_ids_are_the_librarys(spark, stages):
    want = {i: expected(t)[0] for i, t in texts(stages[4]).items()}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in stages[5]} == want
    assert all(r.n_tokens == len(want[r.doc_id]) for r in stages[5])
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, stages[5]))


def test_no_documents_and_nulls(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    assert all(stage(spark, spark.createDataFrame([], columns), FOLDER).count() == 0 for _, stage in corpus_pipeline.STAGES)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a", None, None, 1)], columns)
    sizes = [stage(spark, odd, FOLDER).count() for _, stage in corpus_pipeline.STAGES]
    assert sizes == [0, 4, 4, 4, 4]
