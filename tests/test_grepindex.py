import random
import re

import pytest

from failsift.operators import grepindex as gi
from failsift.operators.loglines import grep

PATTERNS = [
    "error", "[Ff]ailed|error", "^.*[Ee]rror: +disk", "disk (full|gone) now", "colou?r", r"exit\.code", r"a{2,}bcd", "fatal+ end", "x*yes",
    "(?i)ERROR", "ab", ".", "^$", r"\d+ms", r"(?:very )?slow test", "a|b|", r"\Qa.b\E", r"\x41bc", "[]x]abc", "line 1[0-9]9 end", "漢字漢", "no such thing at all",
]
WORDS = ["error", "Failed", "Error:", "disk", "full", "now", "color", "colour", "exit.code", "exitcode", "aaabcd", "fatall", "end", "xxyes", "12ms", "slow", "test", "very", "Abc", "]abc", "漢字漢字", "a.b", ""]


def corpus():
    rng = random.Random(4)
    logs = [(i, "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))) for _ in range(rng.choice([1, 3, 63, 64, 65, 200]))) + rng.choice(["", "\n", "\n\n"])) for i in range(40)]
    logs += [(100, ""), (101, None), (102, "\n"), (103, "a\r error b"), (104, "z" * 200_000 + " error"), (105, "\n".join(f"line {i} end" for i in range(5000)))]
    return logs


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("grep-index"))
    logs = spark.createDataFrame(corpus(), "job_id BIGINT, trace STRING").cache()
    gi.write_grep_index(logs.repartition(5), folder)
    return logs, folder


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_grep_over_whole_logs(spark, index, pattern):
    logs, folder = index
    try:
        want = sorted(map(tuple, grep(logs, pattern).collect()))
    except Exception:
        pytest.skip("the pattern is none of the engine's")
    assert sorted(map(tuple, gi.grep_indexed(spark, folder, pattern).collect())) == want


def test_blocks_that_cannot_match_are_not_read(spark, index):
    logs, folder = index
    assert {tuple(r) for r in gi.candidate_blocks(spark, folder, "line 4321 end").collect()} == {(105, 4321 // gi.BLOCK_LINES)}
    assert gi.candidate_blocks(spark, folder, "no such thing at all").count() == 0
    plan = gi.candidate_blocks(spark, folder, "error")._jdf.queryExecution().executedPlan().toString()
    assert "array_contains" in plan and "text" not in plan


@pytest.mark.parametrize(
    "pattern, runs",
    [
        ("[Ff]ailed|error", [["ailed"], ["error"]]),
        ("colou?r ab", [["colo", "r ab"]]),
        (r"exit\.code\d", [["exit.code"]]),
        ("abc(def)ghi", [["abc", "ghi"]]),
        ("abc(d|e)?", [["abc"]]),
        ("abc+def{2}ghi", [["abc", "ghi"]]),
        ("abcd*", [["abc"]]),
        (r"\bcde", [["cde"]]),
        ("abc|x", None), ("(?i)abc", None), (r"\Qabc\E", None), (r"\x41bc", None), ("[[a]b]cde", None), ("(abc", None), ("abc)", None), ("", None),
    ],
)
def test_required_runs(pattern, runs):
    assert gi.required_runs(pattern) == runs


def test_runs_stand_in_every_match():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(4)) for _ in range(3000)]
    for pattern in PATTERNS:
        if (alternatives := gi.required_runs(pattern)) is not None:
            for text in texts:
                if re.search(pattern, text):
                    assert any(all(run in text for run in runs) for runs in alternatives)


def test_no_logs(spark, tmp_path):
    gi.write_grep_index(spark.createDataFrame([(None, "error")], "job_id BIGINT, trace STRING"), str(tmp_path))
    assert gi.grep_indexed(spark, str(tmp_path), "error").count() == 0
