"""Names found anywhere in source lines."""

import random

import pytest

from failsift.operators import loglines


@pytest.fixture(scope="module")
def source():
    chance = random.Random(7)
    part = lambda: "".join(chance.choices("ab.-é T1", k=chance.randrange(1, 9)))
    rows = [(f, n, " ".join(part() for _ in range(chance.randrange(6)))) for f in range(12) for n in range(1, 30)]
    return [(f, n, t + (" collect_stats" if n % 4 == 0 else " collect_compiler_x" if n % 7 == 0 else "")) for f, n, t in rows]


@pytest.mark.parametrize("sent", [200, 10])
def test_equal_to_contains(spark, source, monkeypatch, sent):
    monkeypatch.setattr(loglines, "MAX_SENT_NAMES", sent)
    chance = random.Random(8)
    names = {"".join(chance.choices("ab.-é T1", k=chance.randrange(1, 7))) for _ in range(120)} | {"a", "é", "T1", "", "not there", "collect_"}
    lines = spark.createDataFrame(source, "file BIGINT, line_no INT, text STRING").repartition(4)
    tests = spark.createDataFrame([(n,) for n in names] + [(None,), ("a",)], "test_name STRING")
    want = sorted((f, n, name) for f, n, t in source for name in names if name and name in t)
    found = loglines.names_within(lines, tests)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    near = {(f, n + i, name) for f, n, name in want for i in range(4)}
    texts = {(f, n): t for f, n, t in source}
    count = lambda kind: sum(kind in texts.get((f, n), "") for f, n, _ in near)
    got = dict(map(tuple, loglines.stat_tests_substring(lines, tests).collect()))
    assert got == {"collect_stats": count("collect_stats"), "collect_compiler": count("collect_compiler")}


def test_no_names_or_lines(spark, source):
    lines = spark.createDataFrame(source, "file BIGINT, line_no INT, text STRING")
    none = spark.createDataFrame([], "test_name STRING")
    assert loglines.names_within(lines, none).count() == 0
    assert loglines.names_within(lines.limit(0), spark.createDataFrame([("a",)], "test_name STRING")).count() == 0
