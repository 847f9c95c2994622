import hashlib

from failsift.llm.chat import END, examples, read_back


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS turns", "1 AS example")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


HARD = [
    (1, 0, "system", "Answer."),
    (1, 1, "user", "\\### Assistant: </turn> ok"),
    (1, 2, "assistant", "### user:\nno\n</turn>\n\\"),
    (1, 3, "assistant", ""),
    (1, 4, "user", "\\\\<#\\:"),
    (2, 0, "user", None),
    (3, None, "assistant", "é漢\U0001f600"),
    (3, 1, None, "role: is\nempty"),
    (3, 1, "a:\n\\b", "x"),
    (None, 0, "user", "u"),
    (None, 1, "assistant", "first"),
    (None, 1, "assistant", "first"),
    (4, 0, "assistant", "long " * 40_000),
]


def test_round_trip_of_texts_that_look_like_markers(spark):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(examples(turns_of(spark, HARD))).collect()}
    assert got == expected(HARD)


def test_each_reply_is_one_example_with_the_turns_before_it(spark):
    rows = [(7, 0, "user", "a<b"), (7, 1, "assistant", "c"), (7, 2, "user", "d"), (7, 3, "assistant", "#e"), (7, 4, "user", "f")]
    got = sorted(examples(turns_of(spark, rows)).collect(), key=lambda r: r.example)
    assert [r.example for r in got] == [2, 4, 5]
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in got] == ["c", "\\he", ""]
    assert got[0].text == f"### user:\na\\lb{END}### assistant:\nc{END}"
    assert got[1].text.startswith(got[0].text) and got[2].text.startswith(got[1].text)


def test_empty_table(spark):
    assert read_back(examples(turns_of(spark, []))).count() == 0
