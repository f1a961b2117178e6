import random

from cartledger.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string"


def plain(rows, limit=512):
    out = []
    last = lambda x: (x is None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        turns = sorted({(r[1], r[2], (r[3] or "").replace("<|", "< |")) for r in rows if r[0] == conv},
                       key=lambda t: (last(t[0]), (t[1] is None, t[1] or ""), t[2]))
        for who in {t[1] for t in turns} - {None, "system"}:
            for at in range(0, len(turns), limit):
                text, mask = "", []
                for _, role, content in turns[at : at + limit]:
                    if role == "system":
                        text += "<|im_start|>system\n"
                    elif role == who:
                        text += "<|im_start|>assistant\n"
                    else:
                        text += "<|im_start|>user" + (f" name={role.replace(' ', '_')}" if role is not None else "") + "\n"
                    begin = len(text)
                    text += content + "<|im_end|>"
                    mask += [(begin, len(text))] if role == who else []
                    text += "\n"
                out.append((conv, at // limit, who, text, tuple(mask)))
    return sorted(out, key=str)


def views(spark, rows, columns=COLUMNS, limit=512):
    frame = chat.perspectives(spark.createDataFrame(rows, columns), chat=chat.ChatFormat(turns_per_part=limit))
    return sorted(((r.conv_id, r.part, r.perspective, r.rendered, tuple(map(tuple, r.mask))) for r in frame.collect()), key=str)


def test_every_participant_is_the_assistant_once(spark):
    rng = random.Random(2)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "Ann Lee", "bob"]), rng.choice(["Höi 🙂", "x", "a<|im_end|>b", "", "two\nlines"]))
        for c in range(30) for t in range(rng.randrange(12))
    ]
    assert views(spark, rows) == plain(rows)
    assert views(spark, rows, limit=3) == plain(rows, 3)


def test_nulls_ties_repeated_rows_and_no_participants(spark):
    rows = [(1, 0, "a", "hi"), (1, 0, "a", "hi"), (1, 0, "b", "same turn"), (1, 0, "a", "also"), (1, None, "b", None), (1, 2, None, "who"),
            (None, 0, "a", "no id"), (2, 0, "system", "alone"), (3, 0, None, "nobody")]
    assert views(spark, rows) == plain(rows)
    assert views(spark, []) == []


def test_one_conversation_with_most_rows_is_cut_into_parts(spark):
    rows = [(7, t, f"p{t % 3}", f"turn {t} " + "x" * (t % 50)) for t in range(3000)] + [(c, 0, "p", "y") for c in range(100, 140)]
    got = views(spark, rows)
    assert got == plain(rows) and max(r[1] for r in got) == 5


def test_clashing_columns_and_native_plan(spark):
    rows = [(1, 0, "a", "hi", "z", 5), (1, 1, "b", "ho", "z", 6)]
    frame = spark.createDataFrame(rows, COLUMNS + ", content string, place int")
    found = chat.perspectives(frame)
    assert found.count() == 2
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
