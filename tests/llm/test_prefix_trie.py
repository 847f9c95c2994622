import hashlib
import random
import zlib

import pytest

from failsift.llm import prefix_trie
from failsift.llm.prefix_trie import rebuilt_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                children(node),
                sum(children(n) == 0 for n in below),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def result(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'x' AS block", "2 AS n", "'y' AS digest")
    return sorted(map(tuple, rebuilt_trie(turns).collect()), key=str)


def talk(chance, conv_id, turns, kinds=3):
    return [(conv_id, i, "user" if i % 2 == 0 else "assistant", f"say {chance.randrange(kinds)} é"[: chance.choice([5, 5, 9])]) for i in range(turns)]


def test_equal_to_brute_force(spark):
    chance = random.Random(3)
    rows = [r for c in range(-30, 250) for r in talk(chance, c, chance.randrange(1, 14)) if chance.random() < 0.99]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("part", [512, 4])
def test_long_conversations_go_on_in_blocks(spark, monkeypatch, part):
    monkeypatch.setattr(prefix_trie, "PART", part)
    chance = random.Random(4)
    whole = talk(chance, 0, 90)
    rows = whole + [(c, *r[1:]) for c in (5, 7, 11) for r in whole[: 24 + c]] + [(31, *r[1:]) for r in whole] + talk(chance, 200, 40, kinds=1)
    assert result(spark, rows) == brute(rows)


def test_one_node_for_many_equal_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(3_000) for t in range(3 if c % 3 else 1)]
    got = result(spark, rows)
    paths = {c: (1 if c % 3 == 0 else 3) for c in range(3_000)}
    assert {(r[1], r[3]) for r in got} >= {(0, 3_000)} and max(r[1] for r in got) <= max(paths.values())
    assert [r for r in got if r[1] <= 1] == [r for r in brute(rows) if r[1] <= 1]


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "left out"),
        (101, 0, None, None),
        (101, None, "user", "first"),
        (101, 0, "", ""),
        (101, 0, "user", "tie"),
        (102, 1, "user", "x" * 200_000),
        (103, 0, "a:b", ""),
        (103, 0, "a", "b"),
        (199, 5, "user", "alone"),
    ]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows[:0] + [(None, 0, "user", "x")]) == []


def test_without_turns_at_the_root(spark):
    ids = [c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 > 0][:5]
    got = result(spark, [(c, 0, "user", "x") for c in ids])  # no conversation 0 to take heads from
    assert got == [(ids[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
