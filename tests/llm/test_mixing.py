import math

import pytest

from failsift.llm.mixing import mix_sources, targets


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, got = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not full:
            return got | {s: weight[s] * level for s in open_}
        for s in full:
            got[s] = cap * sizes[s]
            left -= got[s]
        open_ -= full
    return got


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 0, "é": 7, None: 300}, {"x": 3}, {"a": 0, "b": 0}, {"a": 40, "b": 40}, {f"s{i}": 50 + i * i % 17 for i in range(20)}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in targets(table).collect()} == pytest.approx(filled(sizes))


def test_words_come_near_the_targets_and_keys_decide(spark, docs_of):
    rows = [(i, "w " * (1 + i % 13), "hot" if i % 3 else f"s{i % 9}") for i in range(3000)]
    docs = docs_of(rows)
    got = mix_sources(docs, bucket_rows=50).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 13 / 2
        assert all(r.taken in (r.size * r.epochs, r.size * (r.epochs + 1)) and r.taken <= 2 * r.size for r in mine)
    assert sorted(got) == sorted(mix_sources(docs, bucket_rows=7).collect())


def test_heavier_documents_are_chosen_more_often(spark, docs_of):
    docs = docs_of([(i, "w", "a" if i < 4000 else "b") for i in range(8000)])
    mixed = mix_sources(docs, quality=docs["doc_id"] % 2 * 3 + 1.0, weights=(1,)).where("source = 'a' AND chosen").collect()
    heavy = sum(r.doc_id % 2 for r in mixed) / len(mixed)
    # Without replacement, weights 4 and 1: a share p of the heavy is left when p^(1/4) of the light is.
    assert 0.55 < heavy < 0.85 and not math.isclose(heavy, 0.5, abs_tol=0.02)


def test_defined_cases(docs_of):
    docs = docs_of([(1, None, "a"), (2, "", "a"), (None, "one two", None), (3, "x " * 100_000, "b"), (3, "x " * 100_000, "b"), (4, "t", "c")])
    got = mix_sources(docs).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.size, r.taken) for r in got if r.size == 0} == {(1, 0, 0), (2, 0, 0)}
    assert all(r.taken <= 2 * r.size for r in got)
    assert mix_sources(docs.limit(0)).count() == 0
