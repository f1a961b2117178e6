import random

import numpy as np
import public_tokenizers
import pytest

from cartledger.llm import token_counts
from cartledger.staging import StageArea

END = 50256
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def folder(spark):
    return StageArea.of(spark).path("token_files_test")


def scanned(spark, where, **settings):
    return sorted((r.file, r.doc_no, r.n_tokens, r.terminated) for r in token_counts.scan(spark, where, END, **settings).collect())


def plain(name, tokens):
    out, size = [], 0
    for t in tokens:
        if t == END:
            out.append((name, len(out), size, True))
            size = 0
        else:
            size += 1
    return out + ([(name, len(out), size, False)] if size else [])


@pytest.mark.parametrize("width, block", [(2, 2), (2, 64), (2, 1 << 20), (4, 12), (4, 1001)])
def test_blocks_are_stitched(spark, tmp_path, width, block):
    rng = random.Random(width * block)
    want = []
    for f in range(6):
        tokens = [END if rng.random() < (0.3, 0.01, 0)[f % 3] else rng.randrange(50000) for _ in range(rng.randrange(300 if block < 64 else 3000))]
        # The separator's bytes across two tokens are no separator.
        tokens += [0x5000, 0x00C4, 0xC450 >> 8, END] if f % 2 else []
        (tmp_path / f"f{f}.bin").write_bytes(np.array(tokens, f"<u{width}").tobytes())
        want += plain(f"f{f}.bin", tokens)
    assert scanned(spark, str(tmp_path), width=width, block_bytes=block) == sorted(want)


def test_written_files_hold_the_documents_ids(spark):
    texts = ["Hello wörld", None, "", "x" * 30_000, "a line\nand another\r\n", "<|endoftext|>", "PÄ PÄ", "same", "same"]
    where = folder(spark)
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, value int").coalesce(1)
    token_counts.write_token_files(frame, where, PATH, public_tokenizers.PATTERN, END)
    encoding = token_counts._tokenizer(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    want = [len(token_counts._tokens(encoding, t or "")) for t in texts]
    got = scanned(spark, where, block_bytes=1000)
    assert [r[2] for r in got] == want and all(r[3] for r in got)
    raw = b"".join(r.content for r in spark.read.format("binaryFile").load(where).collect())
    tokens = np.frombuffer(raw, "<u2").tolist()
    assert encoding.decode(tokens[: tokens.index(END)]) == texts[0]


def test_no_documents_and_broken_files(spark, tmp_path):
    where = folder(spark)
    empty = spark.createDataFrame([], "text string")
    token_counts.write_token_files(empty, where, PATH, public_tokenizers.PATTERN, END)
    assert scanned(spark, where) == []
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number of tokens"):
        scanned(spark, str(tmp_path))


def test_ids_are_those_of_the_whole_text_whatever_its_shape(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 12)))
    words = [word() for _ in range(20_000)]
    mixed = "".join(rng.choices("abcXYZ0189", k=3_000))
    texts = [" ".join([*words[:10_000], "http://x.org/" + "".join(rng.choices("abc/0189-", k=2_004)), *words[10_000:]])]
    texts += [" ".join([*words[:3_000], mixed, *words[3_000:6_000]]), "\n".join(words[:4_000]), mixed * 20, "漢字かな" * 2_000]
    encoding = token_counts._tokenizer(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    want = [len(encoding.encode(t)) for t in texts]
    where = folder(spark)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    token_counts.write_token_files(frame, where, PATH, public_tokenizers.PATTERN, END)
    assert [r[2] for r in scanned(spark, where)] == want


def test_runs_of_blanks_beyond_the_matcher_are_split_as_it_does():
    encoding = token_counts._tokenizer(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    blanks = " " * 1_200_000
    want = [*encoding.encode("one, two's\r\nx"), *encoding._encode_single_piece(blanks[1:]), *encoding.encode(" a\x1c\x85b")]
    assert token_counts._tokens(encoding, f"one, two's\r\nx{blanks}a\x1c\x85b").tolist() == want
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choices("ab1é漢 \t\n\r\x0b\x1c\x1f\x85\xa0 ​　'stll.!٣Ⅷ²", k=40))
        split = [m.group() for m in token_counts.regex.finditer(public_tokenizers.PATTERN, text)]
        assert [t for p in split for t in encoding._encode_single_piece(p)] == encoding.encode(text)
