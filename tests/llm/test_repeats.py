import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from failsift.llm import repeats
from failsift.llm.repeats import GRAM, WINDOW, without_repeats


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in words for i in range(len(w) - WINDOW + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {k for i in range(len(w) - WINDOW + 1) if seen[tuple(w[i : i + WINDOW])] > 1 for k in range(i, i + WINDOW)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs, **options):
    return sorted(map(tuple, without_repeats(docs, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(5)
    words = [f"w{i}" for i in range(200)] + ["é", "日本", "ı́"]
    text = lambda n: " ".join(chance.choices(words, k=n))
    passages = [text(60), text(36), text(35), text(34)]
    made = []
    for i in range(300):
        # one passage in a third of the documents, each time in other surroundings
        passage = passages[0] if i % 3 == 0 else chance.choice(passages + [""])
        made.append((i, f"{text(chance.randrange(70))}\n{passage}\t\v{text(chance.randrange(70))}"))
    made += [(300 + i, made[4][1]) for i in range(40)]
    return made + [(1, made[1][1]), (1, "another text under the same id"), (None, made[2][1]), (None, None), (7, "")]


@pytest.mark.parametrize("wide", [2_000, 40, 1])
def test_equal_to_brute_force(docs_of, rows, wide):
    assert result(docs_of(rows), wide=wide) == brute(rows)


def test_repeats_within_one_text(docs_of):
    chance = random.Random(1)
    rows = [(1, "a " * 300), (2, "x y " * 60), (3, " ".join(chance.choices("ab", k=2_000))), (4, "b " * 35), (5, "c " * 36)]
    assert result(docs_of(rows)) == brute(rows)


def test_a_long_text_is_cut_in_parts_that_overlap(docs_of, monkeypatch):
    chance = random.Random(2)
    words = [f"w{i}" for i in range(50_000)]
    passage = " ".join(chance.choices(words, k=100))
    rows = [(1, " ".join(chance.choices(words, k=400_000)) + " " + passage), (2, "start " + passage), (3, "z" * 2_000_000)]
    assert result(docs_of(rows)) == brute(rows)
    monkeypatch.setattr(repeats, "PART_WORDS", 97)
    parts = [np.concatenate(x) for x in zip(*repeats.super_kmers(repeats.Words([rows[1][1].encode() * 5])))]
    assert (np.cumsum(parts[1]) - parts[1] == parts[0]).all()  # every window once, in order


def test_super_kmers_cover_every_window_with_its_minimiser():
    chance = random.Random(3)
    texts = [" ".join(chance.choices([f"w{i}" for i in range(30)], k=n)).encode() for n in (0, 34, 35, 200, 36)]
    words = repeats.Words(texts)
    assert list(np.diff(words.bounds)) == [0, 34, 35, 200, 36]
    parts = [np.concatenate(x) for x in zip(*repeats.super_kmers(words))]
    first, windows = parts[0], parts[1]
    assert windows.sum() == sum(max(0, n - WINDOW + 1) for n in (0, 34, 35, 200, 36))
    assert windows.max() <= WINDOW - GRAM + 1
    text = np.searchsorted(words.bounds, first, "right")
    assert (text == np.searchsorted(words.bounds, first + windows + WINDOW - 2, "right")).all()


def test_windows_with_equal_hashes_are_compared_word_by_word(monkeypatch):
    chance = random.Random(4)
    strings = [" ".join(chance.choices([f"w{i}" for i in range(9)], k=40)) for _ in range(20)]
    strings.append(strings[3].split(" ", 2)[2])
    n = np.ones(len(strings), np.int64)
    want = repeats.repeated_windows(pa.array(strings), n)
    assert want[3] == 0b111100 and want[20] == 0b1111
    monkeypatch.setattr(repeats, "mix", lambda h: h & np.uint64(0))
    assert list(repeats.repeated_windows(pa.array(strings), n)) == list(want)


def test_defined_cases(spark, docs_of):
    assert without_repeats(docs_of([(1, "x")]).limit(0)).count() == 0
    empty = hashlib.sha256().hexdigest()
    assert result(docs_of([(1, None), (2, " \t"), (None, "")])) == sorted([(1, 0, 0, empty), (2, 0, 0, empty), (None, 0, 0, empty)], key=str)
    texts = spark.createDataFrame([("w " * 36, 3)], "text string, doc_id int").selectExpr("*", "1 AS k1", "'x' AS places", "2 AS mini")
    assert result(texts)[0][:3] == (3, 36, 36)
