import random
from itertools import combinations

import numpy as np
import pytest

from failsift.llm import near_dedup as nd
from failsift.llm.components import components
from failsift.llm.words import shingles, word_hashes

WORDS = [f"word{i}" for i in range(4000)]


def brute_force(rows, threshold=nd.THRESHOLD):
    """Least id of the component of each (distinct) id, over all pairs."""
    sets = [shingles(h) for h in word_hashes([t for _, t in rows])]
    cells = np.zeros(nd.CELLS, np.int64)
    for s in sets:
        np.add.at(cells, nd.cells_of(np.unique(s)), 1)
    idf = nd.idf_table(cells, len(rows))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, _), (b, _) in combinations(rows, 2):
        x, y = find(a), find(b)
        if x != y and nd.weighted_jaccard(sets[[i for i, _ in rows].index(a)], sets[[i for i, _ in rows].index(b)], idf) >= threshold:
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def corpus(seed=3, groups=12, loose=40):
    rng, rows = random.Random(seed), []
    passage = [rng.choice(WORDS) for _ in range(60)]
    for g in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 300))] + (passage if g % 3 == 0 else [])
        for copy in range(rng.choice([2, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(" ".join(words))
    rows += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(loose)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_those_of_all_pairs(docs_of):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_force(rows)


def test_pivots_connect_members_that_are_unlike_the_first(docs_of):
    """With one sample per band nearly all of a group share buckets, but only some are alike."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        for place in rng.sample(range(200), 2 + i % 9):
            words[place] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs_of(rows), bands=32, rows=1).collect()}
    assert got == brute_force(rows)
    assert 1 < len(set(got.values())) < 40


def test_sampling_agrees_with_weighted_jaccard():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**32, 3000, dtype=np.uint32))
    keep = rng.random(len(a)) < 0.85
    w = (1 + rng.random(len(a))).astype(np.float32)
    samples = 2000
    x, y = nd.band_keys(a, w, samples, 1), nd.band_keys(a[keep], w[keep], samples, 1)
    assert (x == y).mean() == pytest.approx(w[keep].sum() / w.sum(), abs=0.03)


def test_defined_cases(docs_of):
    long = "lorem ipsum " * 60_000
    rows = [(5, None), (6, ""), (7, " .;"), (None, "a b c"), (9, "A, b C!"), (10, "d"), (None, "e f"), (11, long), (12, long + "end"), (12, "other words here"), (10, "d")]
    got = sorted(((r.doc_id, r.class_id) for r in nd.near_duplicates(docs_of(rows)).collect()), key=str)
    want = [(5, 5), (6, 5), (7, 5), (None, 9), (9, 9), (10, 10), (10, 10), (None, None), (11, 11), (12, 11), (12, 12)]
    assert got == sorted(want, key=str)
    assert nd.near_duplicates(docs_of([])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def counted(monkeypatch):
    """The numbers of pairs that are compared, a list that grows with the calls."""
    numbers, verified = [], nd.verified

    def count(pairs, *args):
        numbers.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(nd, "verified", count)
    return numbers


def edited(rng, base, edits, own=lambda rng: rng.choice(WORDS)):
    words = list(base)
    for place in rng.sample(range(len(base)), edits):
        words[place] = own(rng)
    return words


def test_near_copies_that_are_not_alike_need_few_comparisons(docs_of, monkeypatch):
    """Copies of one text, most of them below the threshold of each other, share all buckets."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 3 - (i % 8 == 0)))) for i in range(160)]
    numbers = counted(monkeypatch)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs_of(rows), bands=24, rows=1).collect()}
    assert got == brute_force(rows)
    assert 1 < len(set(got.values())) < 160
    assert sum(numbers[1:]) < 5 * len(rows)  # the first are those with the first pivots


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_buckets_of_several_families_lose_no_link(docs_of, seed):
    """Families off one text, texts with repeated words and of other lengths; half of a family have edits in one place."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(120)]
    few = [rng.choice(WORDS[:12]) for _ in range(120)]
    texts = []
    for family in range(4):
        start = edited(rng, base if family else few, 5, lambda r: r.choice(WORDS[:30]))
        for copy in range(22):
            words = edited(rng, start, copy % 5, lambda r: r.choice(WORDS[: 3 if copy % 2 else 4000]))
            if copy % 3 == 0:
                words[60:62] = [rng.choice(WORDS) for _ in range(2)]
            texts.append(words[: rng.choice([120, 120, 112])] + words[: rng.choice([0, 0, 9])])
    rng.shuffle(texts)
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs_of(rows), bands=24, rows=1).collect()}
    assert got == brute_force(rows)
    assert 4 < len(set(got.values())) < 80
