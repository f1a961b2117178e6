import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartledger.llm import bpe, queries
from cartledger.llm.pieces import Piece

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def encoded(texts, encoder=None):
    raw = [t.encode() for t in texts]
    piece = Piece(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(int))
    ids, bounds = (encoder or bpe.Encoder(VOCABULARY)).encode(piece)
    data, ends = VOCABULARY.decode(ids, bounds)
    return [
        (ids[bounds[i] : bounds[i + 1]].tolist(), data[ends[i] : ends[i + 1]].tobytes().decode()) for i in range(len(texts))
    ]


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_difficult_texts():
    texts = ["Hello<|endoftext|>wörld İstanbul ΑΣ 'S don't <|startoftext|> 123  x\x85y\x1cz ﬁ é", "", "á ́b\xa0\xa0c",
             "<|endoftext|><|endoftext|>", "ABC'LL'S''s it's I'VE 4x4 @#$ <|endof", "a" * 900, "日本語 한국어 각 🙂👨‍👩‍👧", "\x1c\x1d a\x1fb",
             "x" * 5000 + "é" * 300, "İİ ẞ ŉ ǰ ΐ", "　 ", "it 's " * 50]
    assert encoded(texts) == [expected(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_any_text(texts):
    assert encoded(texts) == [expected(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text("thenigaorsdl'", max_size=60))
def test_words_of_frequent_symbols(text):
    assert encoded([text]) == [expected(text)]


def test_verified_words_are_exact_and_most_proposals_pass():
    rng = random.Random(3)
    parts = ["th", "er", "on", "an", "re", "in", "ing", "tion", "ble", "ea", "st", "ou", "é", "q", "x"]
    words = sorted({"".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(3000)})
    symbols = ["".join(bpe_symbols(w)) for w in words]
    found, merged = VOCABULARY.encode_words(symbols)
    assert found == [VOCABULARY.merged(s) for s in symbols] and 0 < merged < len(words)
    border = [(a, b) for tokens in found for a, b in zip(tokens, tokens[1:])]
    assert VOCABULARY.compatible(np.array([a for a, _ in border]), np.array([b for _, b in border])).all()


def bpe_symbols(word):
    return [piece for piece, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(word)]


def test_a_forgotten_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    encoder = bpe.Encoder(VOCABULARY)
    for texts in (["one two three four five"], ["six one"], ["two", "seven two"]):
        assert encoded(texts, encoder) == [expected(t) for t in texts]


def test_frequent_chunks_and_words_are_learned_once():
    encoder = bpe.Encoder(VOCABULARY, cached=20)
    for n in range(30):
        texts = [f"thntblere, oftenseen {' '.join(f'rare{n}x{i}' for i in range(9))}", "thntblere."]
        assert encoded(texts, encoder) == [expected(t) for t in texts]
    assert len(encoder.newer.codes) + len(encoder.older.codes) <= 40 and len(encoder.words) + len(encoder.older_words) <= 60
    assert encoder.chunks_seen == 3 + 30 * 9  # the three that each piece has were learned with the first
    assert encoder.words_seen <= 20  # "rare", "x" and the digits stand in every piece


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("thenigaorsdl'é0", min_size=1, max_size=80), max_size=30))
def test_merging_many_words_is_merging_each(words):
    symbols = ["".join(bpe_symbols(w)) for w in words]
    assert VOCABULARY.merged_words([s for s in symbols if s]) == [VOCABULARY.merged(s) for s in symbols if s]


def test_ranks_are_those_of_the_file():
    pairs = list(VOCABULARY.rank_of.items())
    a, b = (np.array([f(key, VOCABULARY.size) for key, _ in pairs]) for f in (lambda k, n: k // n, lambda k, n: k % n))
    assert VOCABULARY.ranks(a, b).tolist() == [rank for _, rank in pairs]
    none = VOCABULARY.ranks(b, a)
    assert all(rank == VOCABULARY.rank_of.get(int(y) * VOCABULARY.size + int(x), bpe.NEVER) for x, y, rank in zip(a, b, none))


def test_frames(spark):
    long = " ".join(f"word{i} thntblere" for i in range(100_000))
    rows = [(1, None, "t"), (2, "", "t"), (3, "Same text", "t"), (3, "Same text", "t"), (None, long, None)]
    frame = bpe.with_ids(spark.createDataFrame(rows, "doc_id long, text string, tokens string"), PATH)
    got = sorted(((r.doc_id, r.tokens.n_tokens, np.frombuffer(r.tokens.ids, "<u4").tolist(), r.tokens.decoded) for r in frame.collect()), key=str)
    want = [(i, len(expected(t or "")[0]), *expected(t or "")) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert bpe.with_ids(frame.select("text").limit(0), PATH).count() == 0


def test_query_matches_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {tuple(r) for r in queries.op2_bpe(spark, folder).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in texts:
        ids, decoded = expected(r.text or "")
        want.add((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())))
    assert got == want


@pytest.mark.parametrize("ends", [True, False])
def test_long_and_short_merging_agree(ends):
    word = "therethingsareonthetable" * 5
    assert VOCABULARY._merged_long(VOCABULARY.start(word, ends)) == VOCABULARY._merged_short(VOCABULARY.start(word, ends))


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "some text", 5, "t"), (None, None, 6, None)], "doc_id long, text string, ids int, tokens string")
    got = bpe.with_ids(frame, PATH, into="new")
    assert got.columns == [*frame.columns, "new"]
    assert sorted((r["ids"], r["tokens"] or "", r["new"]["n_tokens"]) for r in got.collect()) == [(5, "t", 2), (6, "", 0)]
    assert bpe.with_ids(frame, PATH).columns == frame.columns  # the struct takes the place of the column


def test_tables_of_the_library_are_not_held_twice():
    assert VOCABULARY.library.get_vocab_size() == 0 < LIBRARY.get_vocab_size()
