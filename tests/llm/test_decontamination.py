import math
import random
from itertools import combinations

import pytest

from failsift.llm import decontamination as dc

RNG = random.Random(9)
WORDS = [f"w{i}" for i in range(3000)]
ITEMS = [(i, " ".join(RNG.choice(WORDS) for _ in range(n))) for i, n in enumerate([15, 20, 30, 55, 200, 6, 5, 3])]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS words", "2 AS hash")


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def found(spark, docs, items=ITEMS, **how):
    return {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark(spark, items), **how).collect()}


def brute_force(rows, items):
    """All alignments of all documents and items."""
    import numpy as np

    from failsift.llm.words import word_hashes

    out = set()
    item_words = list(zip([i for i, _ in items], word_hashes([t for _, t in items])))
    for (doc_id, _), words in zip(rows, word_hashes([t for _, t in rows])):
        for item, own in item_words:
            for shift in range(-len(own) + 1, len(words)):
                if len(words) and np.any(own[max(0, -shift) : len(words) - shift] == words[max(0, shift) : shift + len(own)][: len(own[max(0, -shift) : len(words) - shift])]):
                    agree, width = dc.best_window(words, own, shift)
                    if agree >= (width * dc.AGREE if width >= dc.FUZZY_WORDS else width):
                        out.add((doc_id, item))
                        break
    return out


def test_whole_changed_and_partial_passages_against_all_alignments(spark, docs_of):
    rows = []
    for item, text in ITEMS[:5]:
        words = text.split()
        for k, changes in enumerate([0, 1, 2, 3, 4]):
            changed = list(words)
            for place in RNG.sample(range(len(words)), min(changes, len(words) // 6)):
                changed[place] = "replaced"
            rows.append((item * 10 + k, f"{prose(RNG.randint(0, 60))}. {' '.join(changed).title()}\n{prose(RNG.randint(0, 60))}"))
    rows += [(900 + i, prose(200)) for i in range(30)]
    rows += [(950, " ".join(ITEMS[3][1].split()[:22]) + " " + prose(30)), (951, " ".join(ITEMS[3][1].split()[:10]) + " " + prose(30))]
    got = found(spark, docs_of(rows))
    assert got == brute_force(rows, ITEMS)
    assert {(i * 10, i) for i in range(5)} <= got and (950, 3) in got and (951, 3) not in got


def test_every_allowed_replacement_is_found(spark, docs_of):
    """Items of 1 to 20 words, the allowed number of words replaced at all sets of places."""
    items, rows, want = [], [], set()
    for n in range(1, 21):
        words = [f"item{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        allowed = n - math.ceil(n * dc.AGREE) if n >= dc.FUZZY_WORDS else 0
        sets = list(combinations(range(n), allowed))
        for places in RNG.sample(sets, min(len(sets), 500)):
            rows.append((len(rows), f"{prose(3)} {' '.join('other' if i in places else w for i, w in enumerate(words))} {prose(3)}"))
            want.add((rows[-1][0], n))
        for places in RNG.sample(list(combinations(range(n), allowed + 1)), min(n, 20)):
            rows.append((len(rows), " ".join("other" if i in places else w for i, w in enumerate(words))))
    assert found(spark, docs_of(rows), items) == want


def test_a_common_word_as_an_item(spark, docs_of):
    """One place per document is enough, and items below ``min_words`` can be left out."""
    items = [(1, "the"), (2, "the end"), (3, " ."), (4, "the the the the the the the")]
    rows = [(1, "the " * 50_000 + "end"), (2, "an end"), (3, "The."), (4, "the the the")]
    assert found(spark, docs_of(rows), items) == {(1, 1), (1, 2), (1, 4), (3, 1), (4, 1)}
    assert found(spark, docs_of(rows), items[:3], min_words=2) == {(1, 2)}


def test_many_seeds_are_joined_by_a_shuffle(spark, docs_of, monkeypatch):
    rows = [(1, prose(20) + " " + ITEMS[2][1]), (2, prose(50))]
    monkeypatch.setattr(dc, "MAX_BROADCAST_SEEDS", 0)
    assert found(spark, docs_of(rows)) == {(1, 2)}


@pytest.mark.parametrize("bits", [6, 24])
def test_a_full_filter_only_costs_time(spark, docs_of, bits):
    assert found(spark, docs_of([(1, prose(20) + " " + ITEMS[2][1]), (2, prose(50))]), filter_bits=bits) == {(1, 2)}


def test_defined_cases(spark, docs_of):
    text = ITEMS[1][1]
    rows = [(1, None), (2, ""), (3, ITEMS[6][1]), (4, text), (4, text), (None, text), (5, prose(60_000) + " " + text), (6, text + " " + ITEMS[0][1])]
    docs = docs_of(rows)
    assert found(spark, docs) == {(3, 6), (4, 1), (None, 1), (5, 1), (6, 0), (6, 1)}
    assert found(spark, docs_of([])) == set()
    assert found(spark, docs, [(1, None), (None, text)]) == set()
    assert found(spark, docs, []) == set()
    twice = found(spark, docs, [(1, text), (1, text), (2, text)])
    assert twice == {(d, i) for d in (4, None, 5, 6) for i in (1, 2)}
