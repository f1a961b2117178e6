import pytest

from cartledger.llm import quality

PROSE = "The river ran past the old mill and the children played there until the evening came."
LONG = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(6))


def judged(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["quality"] for r in quality.with_quality(frame).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    "line",
    ["Thre*** anor*** inger### of%%% are&&&", "THE!! HOUSE!! IS!! GREEN!!", "home | news | sport | about", "Menu",
     "Please read our Privacy Policy before you go on with this."],
)
def test_lines_that_fail_go(spark, line):
    (r,) = judged(spark, [f"{LONG}\n{line}"])
    assert (r.kept, r.n_failed_lines, r.clean_text) == (True, 1, LONG)


CHINESE = "河水流过老磨坊孩子们在那里一直玩到傍晚"
JAPANESE = "川は古い水車小屋のそばを流れ、子供たちは夕方まで遊んでいた"
HINDI = "नदी पुरानी चक्की के पास से बहती थी और बच्चे शाम तक वहाँ खेलते रहे"


@pytest.mark.parametrize("line, end", [(CHINESE, "。"), (CHINESE, ""), (JAPANESE, "！"), (JAPANESE, ""), (HINDI, "।"), ("नदी", "।"), ("Да", "…"), ("نعم", "؟")])
def test_prose_of_other_scripts_stays(spark, line, end):
    text = "\n".join(f"{line}{i}{end}" for i in range(80))
    (r,) = judged(spark, [text])
    assert r.n_failed_lines == 0 and r.kept_chars == r.word_chars and r.clean_text == text
    assert r.kept != r.base_failed


@pytest.mark.parametrize("line", ["首页", "Главная", "連絡先"])
def test_labels_of_other_scripts_go(spark, line):
    (r,) = judged(spark, [f"{LONG}\n{line}"])
    assert r.n_failed_lines == 1 and r.kept


def test_a_long_line_may_mention_a_phrase(spark):
    words = " ".join(f"word{i}" for i in range(400))
    one, two = judged(spark, [f"{words} our privacy policy and more.", f"{words}\nSee our privacy policy here."])
    assert one.kept and one.n_failed_lines == 0
    assert two.kept and two.clean_text == words


def test_odd_lines_alike_in_sql(spark):
    import duckdb

    from cartledger.llm import sql
    from tests.parity import rows_of

    odd = [CHINESE, JAPANESE + "！", HINDI, "首页", "ok…", "[x]", "it's", 'say "no"', "»da«", "enable javascript is disabled", "a 𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇",
           "Privacy policy and terms of use apply to all of these many words here", "see cookie policy cookie policy", "ไทยไทยไทยไทย", "ไทย"]
    texts = [(i, "\n".join([line] * 3) + "\n" + PROSE) for i, line in enumerate(odd)] + [(99, "\n".join(odd * 5))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    text = sql.quality_rules().replace("FROM (SELECT *, n_words <", "FROM (SELECT *, n_words + 1000 <").replace("AS kept\n", "AS kept, kept_chars\n")
    want = con.execute(text)
    names = [d[0] for d in want.description]
    got = quality.with_quality(spark.createDataFrame(texts, "doc_id long, text string"), rules=quality.Rules(min_words=-1000))
    got = got.select("doc_id", *[f"quality.{c}" for c in names if c != "doc_id"])
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_a_document_that_loses_too_much_is_rejected(spark):
    menu = " ".join(f"entry{i} |" for i in range(400))
    (r,) = judged(spark, [f"{LONG}\n{menu}"])
    assert not r.kept and not r.base_failed


def test_base_counts(spark):
    (r,) = judged(spark, ["a b c\na b c\n\n  \na b c x # é|\n"])
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (12, 13, 2, 1, 9)
    assert r.base_failed and not r.kept


def test_null_empty_blank_and_very_long(spark):
    rows = judged(spark, [None, "", " \n\t ", "\n", PROSE * 40_000, "x" * 3_000_000])
    assert [r.n_words for r in rows[:4]] == [0, 0, 0, 0] and not any(r.kept for r in rows[:4])
    assert rows[4].n_words == 16 * 40_000 - 39_999 and rows[4].n_repeat_words == rows[4].n_words - 2
    assert (rows[5].n_words, rows[5].word_chars) == (1, 3_000_000)


def test_repeated_rows_and_clashing_columns(spark):
    columns = "doc_id long, text string, quality string, kept int, clean_text string"
    frame = spark.createDataFrame([(1, LONG, "q", 7, "c"), (1, LONG, "q", 7, "c"), (None, LONG, None, None, None)], columns)
    kept = quality.cleaned(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)
    assert quality.cleaned(frame.limit(0)).count() == 0
