import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from failsift.functions.text import normalise, terms_of, tokens
from failsift.operators import index, search
from failsift.plans import lookup


def logs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "job_id BIGINT, trace STRING")


def ids(df):
    return sorted(r.job_id for r in df.collect())


def test_token_rule(spark):
    texts = [
        "Échec du-test_1",
        "Échec",
        "straße SØREN łódź",
        "a\r\nb\tc",
        "",
        "...",
        "日本 語 ２ ñandú",
        "x",
        "ộ",
    ]
    want = [
        " echec du test 1 ",
        " echec ",
        " straße søren łodz ",
        " a b c ",
        "  ",
        "  ",
        " 日本 語 ２ nandu ",
        " x ",
        " ộ ",
    ]
    got = logs(spark, texts).select("job_id", normalise(F.col("trace")).alias("n")).orderBy("job_id").collect()
    assert [r.n for r in got] == want
    assert [" " + " ".join(terms_of(t)) + " " for t in texts] == want


def test_python_and_spark_agree_on_tokens(spark):
    rng = random.Random(5)
    alphabet = "abzAZ09 _-.'\n\réÉèßñÑçöÜøłœŁİǿ̧́ﬁ½²日ա\x1b["
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)]
    got = logs(spark, texts).select("job_id", tokens(normalise(F.col("trace"))).alias("t")).collect()
    for r in got:
        assert [t for t in r.t if t] == terms_of(texts[r.job_id]), texts[r.job_id]


def test_phrase_matches_whole_tokens_in_sequence(spark):
    df = logs(spark, ["odd end of redwood barked", "redwood bark", "bark redwood", "REDWOOD--BARK!"])
    assert ids(search.matches(df, search.phrase("redwood bark"))) == [1, 3]
    assert ids(search.matches(df, search.phrase("redwood", "bark"))) == [1, 3]
    assert ids(search.matches(df, search.prefix("redwood bark"))) == [0, 1, 3]
    assert ids(search.matches(df, search.initial("redwood"))) == [1, 3]
    assert ids(search.matches(df, search.phrase('"redwood"'))) == [0, 1, 2, 3]


def test_boolean_operators(spark):
    df = logs(spark, ["a b", "a c", "b c", ""])
    a, b, c = (search.phrase(t) for t in "abc")
    assert ids(search.matches(df, search.all_of(a, b))) == [0]
    assert ids(search.matches(df, search.any_of(a, b))) == [0, 1, 2]
    assert ids(search.matches(df, search.but_not(a, c))) == [0]
    assert ids(search.matches(search.with_norm(df), search.any_of(search.all_of(a, c), search.but_not(b, c)))) == [0, 1]


@pytest.mark.parametrize("build", [search.phrase, search.prefix, search.initial])
@pytest.mark.parametrize("text", ["", " ", "--"])
def test_empty_conditions_are_refused(build, text):
    with pytest.raises(ValueError):
        build(text)


def test_empty_index_arguments_are_refused(spark):
    terms = index.term_rows(logs(spark, ["a"]))
    for call in (
        lambda: index.jobs_with_near(terms, "a", "-"),
        lambda: index.jobs_with_all(terms),
        lambda: index.jobs_with_any(terms, "a b"),
        lambda: index.jobs_with_prefix(terms, ""),
        lambda: index.jobs_with_phrase(terms, ""),
    ):
        with pytest.raises(ValueError):
            call()


def test_term_rows(spark):
    got = index.term_rows(logs(spark, ["x Y x", ""])).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("x", 0, 0), ("y", 0, 1), ("x", 0, 2)]


def random_docs(seed, n, words="a b c d", length=14):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words.split()) for _ in range(rng.randrange(length))) for _ in range(n)]


def starts(doc, phrase):
    doc, phrase = doc.split(), phrase.split()
    return [i for i in range(len(doc)) if doc[i : i + len(phrase)] == phrase]


def near(doc, phrases, distance):
    for choice in product(*[starts(doc, p) for p in phrases]):
        last = max(choice)
        if all(last - s - len(p.split()) <= distance for s, p in zip(choice, phrases)):
            return True
    return False


@pytest.mark.parametrize(
    "phrases", [["a", "b"], ["a", "a"], ["a", "b", "c"], ["a b", "c"], ["a b", "b c"], ["d", "a a", "b"], ["c"]]
)
@pytest.mark.parametrize("distance", [0, 1, 3])
def test_near_against_all_choices(spark, phrases, distance):
    docs = random_docs(len(phrases) + distance, 150)
    terms = index.term_rows(logs(spark, docs))
    want = [i for i, d in enumerate(docs) if near(d, phrases, distance)]
    assert ids(index.jobs_with_near(terms, *phrases, distance=distance)) == want


def test_near_across_blocks_of_a_long_log(spark, monkeypatch):
    monkeypatch.setattr(index, "_BLOCK", 8)
    docs = random_docs(9, 60, words="a b x x x x x x x x", length=120)
    terms = index.term_rows(logs(spark, docs))
    for distance in (0, 2):
        want = [i for i, d in enumerate(docs) if near(d, ["a", "b"], distance)]
        assert ids(index.jobs_with_near(terms, "a", "b", distance=distance)) == want


def test_index_and_scan_agree(spark):
    docs = random_docs(3, 200)
    df = logs(spark, docs)
    terms = index.term_rows(df)
    a, b, c = (search.phrase(t) for t in "abc")
    pairs = [
        (index.jobs_with_all(terms, "a", "b", "c"), search.all_of(a, b, c)),
        (index.jobs_with_any(terms, "a", "b"), search.any_of(a, b)),
        (index.jobs_with_but_not(terms, "a", "b"), search.but_not(a, b)),
        (index.jobs_with_phrase(terms, "a b", "a"), search.phrase("a b a")),
        (index.jobs_with_initial(terms, "a b"), search.initial("a b")),
        (index.jobs_with_prefix(terms, "a"), search.prefix("a")),
    ]
    for by_index, condition in pairs:
        assert ids(by_index) == ids(search.matches(df, condition))


def test_searches_use_no_pairs(spark):
    terms = index.term_rows(logs(spark, ["a b"]))
    plan = index.jobs_with_near(terms, "a b", "c")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def job_rows(spark, n):
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        stamp = (start + timedelta(minutes=i // 2)).strftime("%Y-%m-%dT%H:%M:%SZ")
        runner = '{"id":3,"description":"r"}' if i % 2 else "null"
        rows.append((i, f"https://x/{i}", f'{{"created_at":"{stamp}","name":"job {i}","runner":{runner}}}'))
    return spark.createDataFrame(rows, "job_id BIGINT, job_url STRING, job_blob STRING")


def test_pages(spark):
    jobs = job_rows(spark, 105)
    df = logs(spark, ["hit" if i < 103 else "miss" for i in range(105)])
    pages = [lookup.find(jobs, df, "HIT", page=p).collect() for p in (1, 2, 3, 4)]
    assert [[r.job_id for r in p] for p in pages] == [list(range(102, 52, -1)), list(range(52, 2, -1)), [2, 1, 0], []]
    assert [{r.has_next for r in p} for p in pages] == [{True}, {True}, {False}, set()]
    assert pages[2][1].created_at == datetime(2024, 1, 1) and pages[2][1].runner_name == "r"
    zero = lookup.find(jobs, df, "hit", page=0).collect()
    assert [r.job_id for r in zero] == [r.job_id for r in pages[0]]


def test_a_full_last_page_has_no_next(spark):
    jobs, df = job_rows(spark, 50), logs(spark, ["hit"] * 50)
    got = lookup.find(jobs, df, search.phrase("hit")).collect()
    assert len(got) == 50 and not any(r.has_next for r in got)


@pytest.mark.parametrize("keyword", [None, "", '""'])
def test_no_keyword_is_no_search(spark, keyword):
    assert not search.is_search(keyword)
    assert lookup.find(job_rows(spark, 3), logs(spark, ["a"] * 3), keyword).count() == 0


def test_shown_rows_and_total(spark):
    jobs, df = job_rows(spark, 2), logs(spark, ["a", "a"])
    shown = search.shown(lookup.find(jobs, df, "a")).orderBy("job_id").collect()
    assert [(r.runner_id, r.runner_name, r.created_at, r.log_url) for r in shown] == [
        ("N/A", "N/A", "2024-01-01 00:00:00", "https://x/0/raw"),
        ("3", "r", "2024-01-01 00:00:00", "https://x/1/raw"),
    ]
    assert lookup.total(df, search.phrase("a")).first().matches == 2


def test_a_page_is_taken_without_a_full_sort(spark):
    page = lookup.find(job_rows(spark, 3), logs(spark, ["a"] * 3), "a")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=51" in plan
    assert not any("job_blob" in line for line in plan.splitlines() if "Exchange" in line)


def test_trees_agree_over_logs_and_index(spark):
    from failsift.operators.index import term_rows
    from failsift.operators.tree import All, But, Either, Initial, Near, Phrase, Prefix, condition, jobs_in_index, jobs_in_logs

    rng = random.Random(12)
    df = logs(spark, [" ".join(rng.choice(["aa", "ab", "ba", "bb", "abc"]) for _ in range(rng.randint(0, 7))) for _ in range(120)])
    index = term_rows(df)

    def leaf():
        text = " ".join(rng.choice(["aa", "ab", "ba", "a", "--"]) for _ in range(rng.randint(1, 3)))
        return rng.choice([Phrase, Prefix, Initial])(text)

    def tree(depth):
        if depth == 0:
            return leaf()
        kind = rng.choice([All, Either, But])
        return But(tree(depth - 1), tree(depth - 1)) if kind is But else kind((tree(depth - 1), leaf(), tree(depth - 1)))

    for depth in (0, 0, 0, 0, 1, 1, 2):
        t = tree(depth)
        assert sorted(ids(jobs_in_index(t, index))) == sorted(ids(search.matches(df, condition(t)))), t
    near = But(Near(("aa", "bb"), 1), Phrase("abc"))
    assert sorted(ids(jobs_in_logs(near, df))) == sorted(ids(jobs_in_index(near, index)))


def test_a_keyword_of_signs_finds_nothing(spark):
    df = logs(spark, ["a -- b", ""])
    assert lookup.total(df, "--").first().matches == 0


def test_pages_by_key_and_by_ranges_equal_pages_by_number(spark):
    """Ties of the time are broken by the id."""
    rows = [(i, datetime(2024, 1, 1 + i * 7 % 5)) for i in range(1, 48)]
    results = spark.createDataFrame(rows, "job_id BIGINT, created_at TIMESTAMP").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    last = None
    for page in range(1, 8):
        plain = sorted(map(tuple, search.result_page(results, page, 9).collect()))
        assert [r[0] for r in sorted(plain, key=lambda r: r[3])] == [r[0] for r in ordered[9 * page - 9 : 9 * page]]
        for parts in (1, 4, 40):
            assert sorted(map(tuple, search.page_by_ranges(results, page, 9, parts).collect())) == plain
        if last:
            assert sorted(map(tuple, search.page_after(results, last, 9).collect())) == plain
        if plain:
            shown = max(plain, key=lambda r: r[3])
            last = shown[1], shown[0]
    assert search.page_by_ranges(results.limit(0), 3).count() == 0


def test_a_page_by_its_key_keeps_one_page_per_task(spark):
    results = spark.range(10_000).selectExpr("id AS job_id", "timestamp_seconds(id DIV 3) AS created_at")
    page = search.page_after(results, (datetime(1970, 1, 1, 0, 30), 5_000), 50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=51" in plan
    assert [r.rank for r in sorted(page.collect())] == list(range(50, 0, -1))
