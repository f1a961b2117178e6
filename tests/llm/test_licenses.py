import random
import re

from cartledger.llm import licenses

DOC = "doc_id long, text string"


def words(text):
    """The text with gaps as blanks, A-Z lowered, line breaks kept."""
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return re.sub("[\x00-\x09\x0b-/:-@\\[-`{-\xbf\u2000-\u206f\u3000-\u303f]+", " ", lowered)


def bigrams(text):
    w = words(text).split()
    return set(zip(w, w[1:]))


def plain(docs, templates, percent=80):
    out = {}
    for doc, text in set(docs):
        if text is None:
            continue
        text = words(text)
        blocks = re.split("\n(?: *\n)+", text)
        units = text.split("\n") + [b for b in blocks if "\n" in b] + ([text] if len(blocks) > 1 else [])
        for name in {t[0] for t in templates}:
            hits = []
            for unit in units:
                a = bigrams(unit)
                values = [2 * len(a & b) / (len(a) + len(b)) for n, t in templates if n == name and (b := bigrams(t)) and a]
                if values and max(values) * 100 >= percent - 1e-9:
                    hits.append(max(values))
            if hits:
                out[doc, text, name] = (doc, name, round(max(hits), 9), len(hits))
    return sorted(out.values(), key=str)


def found(spark, docs, templates, percent=80):
    table = spark.createDataFrame(templates, "license_id string, text string")
    frame = licenses.scan(spark.createDataFrame(docs, DOC), table, dice=licenses.Dice(percent))
    return sorted(((r.doc_id, r.license_id, round(r.dice, 9), r.n_units) for r in frame.collect()), key=str)


def test_notices_inside_documents(spark):
    rng = random.Random(6)
    docs = []
    for i in range(60):
        name, text = rng.choice(licenses.NOTICES)
        w = text.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["word", "other", ""])
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)] if rng.random() < 0.5 else [" ".join(w)]
        docs.append((i, "\n".join(["Some prose of this file.", *[""] * rng.randrange(2), *lines, "", "More prose, été."])))
    for percent in (80, 50, 100):
        want = plain(docs, licenses.NOTICES, percent)
        assert want and found(spark, docs, licenses.NOTICES, percent) == want


def test_size_bounds_hold_no_match_back(spark):
    templates = [("short", "a b c d"), ("long", " ".join(f"t{i}" for i in range(100)))]
    docs = [(i, " ".join(f"t{k}" for k in range(i))) for i in range(60, 160, 3)] + [(500 + i, " ".join("abcdefg"[:i])) for i in range(1, 8)]
    assert found(spark, docs, templates) == plain(docs, templates)


def test_nulls_repeated_rows_empty_tables_and_long_texts(spark):
    notice = "Released under the MIT License."
    docs = [(1, None), (2, ""), (3, "one"), (4, notice), (4, notice), (None, f"{notice}\n{notice}"), (5, "MIT " * 200_000), (6, "x" * 2_000_000)]
    templates = [*licenses.NOTICES, ("empty", ""), ("none", None), ("one", "word")]
    want = plain(docs, [t for t in templates if t[1]])
    assert found(spark, docs, templates) == want
    assert found(spark, docs, []) == [] and found(spark, [], templates) == []


def test_native_plan(spark):
    frame = spark.createDataFrame([(1, "x", 2, "n")], DOC + ", n int, license_id string")
    plan = licenses.scan(frame, licenses.notices(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_change_nothing(spark):
    rows = [(1, "Released under the MIT License.", 2, "n", 0.5, 3), (2, "prose", 1, "m", 0.1, 4)]
    frame = spark.createDataFrame(rows, DOC + ", n int, license_id string, dice double, unit int")
    got = sorted(map(tuple, licenses.scan(frame, licenses.notices(spark)).collect()))
    assert got == sorted(map(tuple, licenses.scan(frame.select("doc_id", "text"), licenses.notices(spark)).collect())) and got


def test_units_are_cut_into_words_once(spark):
    docs = spark.createDataFrame([(1, "Licensed under the MIT License.")], DOC)
    plan = licenses.scan(docs, licenses.notices(spark))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("zip_with" in line or "split(" in line for line in filters)


def test_long_units_of_few_different_words(spark):
    templates = [("ab", "a b a"), ("abc", "a b c d")]
    docs = [(1, "a b " * 2000), (2, " ".join(f"w{i}" for i in range(3000))), (3, "a b c d " * 900 + "\nx"), (4, "A  b, c-d\n\ny"), (5, "a")]
    assert found(spark, docs, templates) == plain(docs, templates) != []


def test_gaps_become_one_blank(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("aÉ \t.-\n\xa0 、日", k=rng.randrange(12))) for _ in range(500)]
    replaced = "regexp_replace(text, '{}', ' ')"
    both = [spark_pattern.replace("\\", "\\\\").replace("'", "\\'") for spark_pattern in (licenses.WORD_GAP, licenses.GAP)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(*[f"{replaced.format(p)} AS c{i}" for i, p in enumerate(both)])
    assert all(r.c0 == r.c1 for r in rows.collect())
