import random
import zlib

import numpy as np
import pytest

from failsift.llm import labelled, quality, toxicity

RNG = random.Random(4)
PARTS = ["ba", "do", "ri", "mel", "stu", "on", "ti", "ke", "lor", "an"]


def prose(n):
    return " ".join("".join(RNG.choice(PARTS) for _ in range(RNG.randint(1, 4))) for _ in range(n))


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def model_of(rows, counts=None):
    return toxicity.log_probabilities(np.zeros(toxicity.SYMBOLS**toxicity.ORDER) if counts is None else counts)


def test_sample_is_bounded_and_leaves_out_held_out_rows(spark, docs_of, labels_of):
    docs = docs_of([(i, f"t{i}") for i in range(300)] + [(None, "n")])
    labels = labels_of([(i, 1, None if i == 0 else i % 2) for i in range(300)] + [(None, 0, 1), (2, 0, 1)])
    got = labelled.training_documents(docs, labels, "toxic", limit=50).collect()
    assert len(got) == 50 and not any(is_held_out(r.id) or r.id == 0 for r in got)
    assert all(r.label == (1 if r.id == 2 else r.id % 2) for r in got)


def test_quality_learns_signs_and_repeats(spark, docs_of, labels_of):
    rows, labels = [], []
    for i in range(400):
        text = prose(RNG.randint(5, 120))
        if i % 5 == 0:
            text = " | ".join(text.split())
        elif i % 5 == 1:
            text = " ".join(w for w in text.split() for _ in range(4))
        rows.append((i, text))
        if i % 4:
            labels.append((i, int(i % 5 > 1), 0))
    got = quality.classify_quality(docs_of(rows), labels_of(labels)).collect()
    truth = [(r.predicted, int(r.doc_id % 5 > 1)) for r in got if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) for r in got) and len(got) == 400
    assert sum(p == t for p, t in truth) >= 0.95 * len(truth)
    again = quality.classify_quality(docs_of(rows), labels_of(labels)).collect()
    assert sorted(again) == sorted(got)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, quality.FEATURES))
    y = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    net = quality.fit_network(x[:2000], y[:2000])
    assert net.temperature > 1  # a fit to noise is too sure of itself
    p = net.scores(x[2000:])
    loss = lambda q: -np.log(np.where(y[2000:] == 1, q, 1 - q)).mean()
    net.temperature = 1.0
    assert loss(p) < loss(net.scores(x[2000:]))


def test_context_vectors_by_brute_force(spark, docs_of):
    texts = ["a b c | a", "", None, "b", prose(3000)]
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    index = quality.index_vectors()
    for tokens in quality.token_hashes(texts):
        places = quality.buckets(tokens)
        for i, b in enumerate(places):
            for j in range(max(0, i - quality.REACH), min(len(places), i + quality.REACH + 1)):
                if i != j:
                    want[b] += index[places[j]]
    assert np.array_equal(quality.context_sums(docs_of(list(enumerate(texts)))), want)


def test_language_model_counts_every_four_gram(spark, docs_of):
    texts = ["ab  c", None, "", "É!x" * 3]
    counts = toxicity.four_grams(docs_of(list(enumerate(texts))))
    # Three contexts end at each letter and at the boundary after each run of letters.
    assert counts.sum() >= sum(sum(c.isalpha() for c in t or "") for t in texts)
    p = np.exp(toxicity.log_probabilities(counts)).reshape(-1, toxicity.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


@pytest.fixture(scope="module")
def restorer():
    words = ["stupid", "idiot", "moron", "clown", "the", "letter", "grass", "book", "see", "is", "a", "of", "lamp", "tell"]
    text = " " + " ".join(RNG.choice(words) for _ in range(20_000)) + " "
    c = toxicity.classes(np.frombuffer(("  " + text).encode("utf-32-le"), "<u4"))
    grams = ((c[:-3] * 28 + c[1:-2]) * 28 + c[2:-1]) * 28 + c[3:]
    return toxicity.Restorer(toxicity.log_probabilities(np.bincount(grams, minlength=28**4).astype(float)))


@pytest.mark.parametrize(
    "disguised, plain",
    [
        ("stup1d", "stupid"),
        ("1d10t", "idiot"),
        ("$tup!d", "stupid"),
        ("m0r0n", "moron"),
        ("stuuuupid", "stupid"),
        ("s t u p i d", "stupid"),
        ("m.o.r.o.n", "moron"),
        ("c-l-o-w-n", "clown"),
        ("i d 1 o t", "idiot"),
        ("cl0wwwn", "clown"),
        ("grass", "grass"),
        ("letter", "letter"),
        ("see a book", "see a book"),
    ],
)
def test_disguises_are_read(restorer, disguised, plain):
    assert restorer.restore([f"The {disguised}, of a lamp."]) == [f"the {plain}, of a lamp."]


@pytest.mark.parametrize(
    "disguised, plain",
    [
        ("stuupid", "stupid"),
        ("iidioot", "idiot"),
        ("$ t u p ! d", "stupid"),
        ("s t u p ! d", "stupid"),
        ("c | o w n", "clown"),
        ("! d i 0 t", "idiot"),
        ("l @ m p", "lamp"),
        ("s  t  u  p  i  d", "stupid"),
        ("s/t/u/p/i/d", "stupid"),
        ("s\tt\tu\tp\ti\td", "stupid"),
        ("s,t,u,p,i,d", "stupid"),
        ("s, t, u, p, i, d", "stupid"),
        ("s\nt\nu\np\ni\nd", "stupid"),
        ("$$tupid", "$stupid"),
        ("$$$tup!!d", "$$stupid"),
        ("m00r0n", "moron"),
        ("s e e", "see"),
        ("i s", "is"),
        ("o f", "of"),
        ("grass, letter, a book", "grass, letter, a book"),
        ("moron; a clown", "moron; a clown"),
    ],
)
def test_every_form_of_the_lattice_is_decoded(restorer, disguised, plain):
    assert restorer.restore([f"The {disguised} tell", "", "stupid", f"{disguised}"]) == [f"the {plain} tell", "", "stupid", plain]


def test_whatever_has_several_readings_is_a_span():
    from itertools import product

    for form in map("".join, (p for n in range(2, 6) for p in product("ab1! ,", repeat=n))):
        if form[0] in " ," or form[-1] in " ," or not any(c.isalpha() for c in form):
            continue
        wide = any(a.isalnum() and b.isalnum() for a, b in zip(form, form[1:]))
        if (wide and (" " in form or "," in form)) or all(len(r) == 1 for r in toxicity.lattice(form)):
            continue
        got = toxicity.spans([form, "xyz " + form + " xyz", "", form + ","])
        assert [g.tolist() for g in got] == [[[0, len(form)]], [[4, 4 + len(form)]], [], [[0, len(form)]]], form


def test_a_long_run_of_single_letters_takes_linear_time(restorer):
    assert restorer.restore(["s t u p i d " * 20_000])[0].startswith("stupid")


def test_viterbi_finds_the_least_cost_of_all_readings(restorer):
    from itertools import product

    def cost(path):
        text, total = "", 0.0
        for letter, paid in path:
            total += paid
            text += letter
        kinds = [0, 0, 0]
        for c in text:
            k = toxicity.class_of(c)
            if k or kinds[-1]:
                total -= restorer.log_p[((kinds[-3] * 28 + kinds[-2]) * 28 + kinds[-1]) * 28 + k]
                kinds.append(k)
        if kinds[-1]:
            total -= restorer.log_p[((kinds[-3] * 28 + kinds[-2]) * 28 + kinds[-1]) * 28]
        return total

    for span in ["1d10t", "s t u p 1 d", "booook", "6r4$$", "x|!y"]:
        paths = list(product(*toxicity.lattice(span)))
        least = min(map(cost, paths))
        read = toxicity.decode(span, restorer.log_p)
        assert min(cost(p) for p in paths if "".join(x for x, _ in p) == read) == pytest.approx(least)


def test_toxicity_learns_words_and_stems_and_sees_disguises(spark, docs_of, labels_of):
    rows, labels = [], []
    for i in range(600):
        words = prose(RNG.randint(10, 150)).split()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(RNG.randrange(len(words)), RNG.choice(["moron", "stupid", "vequ" + RNG.choice(PARTS)]))
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000, prose(30) + " you m0r0n and s t u p i d " + prose(20)), (1001, prose(300)), (1002, None), (None, "moron stupid")]
    got = {r.doc_id: r for r in toxicity.classify_toxicity(docs_of(rows), labels_of(labels)).collect()}
    judged = [(got[i].predicted, int(i % 6 == 0)) for i in range(600) if got[i].held_out]
    assert sum(p == t for p, t in judged) >= 0.98 * len(judged)
    assert (got[1000].predicted, got[1001].predicted, got[1002].predicted, got[None].predicted) == (1, 0, 0, 1)


@pytest.mark.parametrize("civil_of_ten", [5, 2])
def test_toxicity_learns_from_labels_that_are_mostly_toxic(spark, docs_of, labels_of, civil_of_ten):
    rng, rows = random.Random(8), []
    for i in range(400):
        words = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        if i % 10 >= civil_of_ten:
            words[rng.randrange(40)] = rng.choice(["moron", "clown"])
        rows.append((i, " ".join(words)))
    labels = labels_of([(i, 1, int(i % 10 >= civil_of_ten)) for i, _ in rows])
    got = toxicity.classify_toxicity(docs_of(rows), labels).collect()
    judged = [r.predicted == int(r.doc_id % 10 >= civil_of_ten) for r in got if r.held_out]
    assert sum(judged) >= 0.98 * len(judged)


@pytest.mark.parametrize("classify, label", [(quality.classify_quality, 1), (toxicity.classify_toxicity, 2)])
def test_defined_cases(docs_of, labels_of, classify, label):
    docs = docs_of([(1, None), (2, ""), (None, "a b"), (3, "| " * 200_000), (3, "x"), (3, "x"), (4, "word")])
    some = classify(docs, labels_of([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, 1, 1), (6, 0, 0), (None, 1, 1)])).collect()
    assert len(some) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in some)
    assert len({r.score for r in some if r.doc_id in (1, 2)}) == 1
    assert len(classify(docs, labels_of([])).collect()) == 7
    assert len(classify(docs, labels_of([(i, 1, 1) for i in range(9)])).collect()) == 7
    assert classify(docs.limit(0), labels_of([(1, 1, 1)])).count() == 0
