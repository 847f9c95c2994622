import random

import corpus_pipeline as cp
from failsift.llm import decontamination, mixing, near_dedup, quality, toxicity
from failsift.llm.tables import stored

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_its_operator_says(spark):
    docs = cp.table(spark, SF, "documents")
    labels, benchmark = cp.table(spark, SF, "labels"), cp.table(spark, SF, "benchmark")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    expected = [
        lambda d: ids(toxicity.classify_toxicity(d, labels).where("predicted = 0")),
        lambda d: ids(quality.classify_quality(d, labels).where("predicted = 1")),
        lambda d: sorted({r.class_id for r in near_dedup.near_duplicates(d).collect()}),
        lambda d: sorted(set(ids(d)) - {r.doc_id for r in decontamination.leaks(d, benchmark).collect()}),
        lambda d: ids(mixing.mix_sources(d)),
    ]
    for (name, stage), want in zip(cp.STAGES, expected):
        kept = stored(stage(spark, docs, SF), "stage")
        assert ids(kept) == want(docs), name
        if name != cp.STAGES[-1][0]:
            assert kept.schema == docs.schema
        docs = kept
    assert ids(cp.run(spark, SF)) == ids(docs)


def test_rows_without_id_and_repeated_rows(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) + str(rng.randint(0, 99)) for _ in range(n))
    a, b, c = prose(80), prose(80), prose(80)
    rows = [(None, a), (None, b), (None, a), (1, b), (2, c), (2, c), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.text or "" for r in kept.collect()) == sorted([a, b, c, ""])
    item = cp.table(spark, SF, "benchmark").first().text
    leaky = docs.union(spark.createDataFrame([(None, prose(9) + " " + item, "en", "s", 1), (7, item, "en", "s", 1)], docs.schema))
    assert cp.drop_leaks(spark, leaky, SF).count() == len(rows)


def test_no_documents(spark):
    docs = cp.table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark, docs_of, tmp_path):
    """A near copy and a leak under one id take no other row of that id with them."""
    words = [f"word{i}" for i in range(400)]
    base, other, third = " ".join(words[:120]), " ".join(words[120:240]), " ".join(words[240:360])
    item = " ".join(f"item{i}" for i in range(30))
    docs = docs_of([(1, base), (7, base + " more"), (7, other), (7, third + " " + item), (8, third + " end"), (None, "x y z"), (None, other[:300])])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = sorted(r.text for r in cp.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert other in kept and "x y z" in kept and other[:300] in kept and len(kept) == 6
    assert (base in kept) != (base + " more" in kept)
    clean = cp.drop_leaks(spark, docs, str(tmp_path))
    assert sorted(clean.columns) == sorted(docs.columns)
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted(
        (r.doc_id or 0, r.text) for r in docs.collect() if item not in r.text
    )


def test_near_copies_that_are_not_alike_need_few_comparisons(spark, docs_of, monkeypatch):
    """Of copies of one text, most below the threshold of each other, the stage compares a few with each."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(4000)]
    base, texts = [rng.choice(words) for _ in range(150)], []
    for i in range(240):
        copy = list(base)
        for place in rng.sample(range(150), 3 - (i % 8 == 0)):
            copy[place] = rng.choice(words)
        texts.append(" ".join(copy))
    numbers, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *args: (numbers.append(pairs.count()), verified(pairs, *args))[1])
    kept = cp.drop_near_duplicates(spark, docs_of(list(enumerate(texts))), SF).count()
    assert 1 < kept < 240
    assert sum(numbers[1:]) < 5 * 240, numbers  # the first are those with the first pivots
