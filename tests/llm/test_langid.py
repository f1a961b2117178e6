import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cartledger.llm import langid, queries


def fold(text):
    return [int(x) for x in langid.FOLD[np.frombuffer(text.encode(), np.uint8)]]


def plain_bits(training, text):
    """Method C with exclusion, one symbol at a time."""
    counts = [defaultdict(Counter) for _ in range(3)]
    for t in training:
        s = [langid.BLANK] * 2 + fold(t)
        for i in range(2, len(s)):
            counts[2][s[i - 2], s[i - 1]][s[i]] += 1
            counts[1][s[i - 1],][s[i]] += 1
            counts[0][()][s[i]] += 1

    def share(context, symbol):
        shorter = (lambda c: share(context[1:], c)) if context else (lambda c: 1 / langid.N)
        seen = counts[len(context)][context]
        if not seen:
            return shorter(symbol)
        left = sum(shorter(c) for c in range(langid.N) if c not in seen)
        escape = len(seen) if left > 0 else 0
        if symbol in seen:
            return seen[symbol] / (sum(seen.values()) + escape)
        return escape / (sum(seen.values()) + escape) * shorter(symbol) / left

    s = [langid.BLANK] * 2 + fold(text)
    return sum(-math.log2(share((s[i - 2], s[i - 1]), s[i])) for i in range(2, len(s)))


COLUMNS = "doc_id long, text string, lang string"
TRAINING = [(1, "the cat", "en"), (2, "that hat", "en"), (3, "le chat é", "fr"), (4, None, "fr"), (5, "no language", None)]


def test_code_lengths_against_the_plain_tree(spark):
    known = {"en": ["the cat", "that hat"], "fr": ["le chat é"]}
    frame = spark.createDataFrame(TRAINING, COLUMNS)
    for text in ("the", "le hat!", "éé 12"):
        (row,) = langid.with_language(spark.createDataFrame([(text,)], "text string"), frame).collect()
        bits = {name: plain_bits(texts, text) for name, texts in known.items()}
        best = min(bits, key=bits.get)
        assert row.language.lang_pred == best
        assert abs(row.language.score - 1 / sum(2 ** (bits[best] - b) for b in bits.values())) < 1e-4


def test_costs_are_probabilities():
    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, langid.N**3, 3000))
    two, one, _ = langid.costs(code, rng.integers(1, 9, len(code)))
    assert np.allclose((2.0**-two).sum(axis=1), 1, atol=1e-3) and np.allclose((2.0**-one).sum(axis=1), 1, atol=1e-3)


def test_undetermined_nulls_and_long_texts(spark):
    frame = spark.createDataFrame(TRAINING, COLUMNS)
    long = "le chat é " * 200_000
    rows = [(1, None, "x", "q"), (2, "", "x", "q"), (3, "12 %", "x", "q"), (4, long, "x", "q"), (4, long, "x", "q"), (None, "the hat", None, None)]
    told = langid.with_language(spark.createDataFrame(rows, "doc_id long, text string, language string, _bits0 string"), frame)
    assert told.columns == ["doc_id", "text", "language", "_bits0"]
    got = [(r.doc_id, *r.language) for r in told.collect()]
    assert sorted((r[:2] for r in got), key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr"), (None, "en")], key=str)
    assert all((r[2] == 0) == (r[1] == "und") and 0 <= r[2] <= 1 for r in got)
    nothing = langid.with_language(frame.select("text"), frame.limit(0))
    assert {tuple(r.language) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.with_language(frame.limit(0), frame).count() == 0


@pytest.mark.parametrize("per_pass", [1, 3])
def test_passes_over_languages_change_nothing(spark, monkeypatch, per_pass):
    frame = spark.createDataFrame([(i, t, f"l{i}") for i, t in enumerate(["abab", "bcbc", "cdcd", "dede"])], COLUMNS)
    want = [tuple(r.language) for r in langid.with_language(frame, frame).orderBy("doc_id").collect()]
    monkeypatch.setattr(langid, "LANGUAGES_PER_PASS", per_pass)
    assert [tuple(r.language) for r in langid.with_language(frame, frame).orderBy("doc_id").collect()] == want
    assert [w[0] for w in want] == ["l0", "l1", "l2", "l3"]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    told = queries.op5_language_id(spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = told.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
