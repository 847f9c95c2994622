import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from failsift.llm import words


def plain_words(text):
    kinds = words._kinds()
    found, run = [], ""
    for c in text.lower() + " ":
        if kinds[min(ord(c), words._FIRST_PRIVATE)] == 1:
            run += c
        elif run:
            found.append(run)
            run = ""
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é1 \n|_ߕ漢\U0001f600", max_size=30), max_size=6))
def test_hashes_tell_words_apart(texts):
    hashes = list(words.word_hashes(texts))
    assert len(hashes) == len(texts)
    names = {}
    for text, found in zip(texts, hashes):
        expected = plain_words(text)
        assert len(found) == len(expected)
        for word, h in zip(expected, found):
            assert names.setdefault(word, int(h)) == int(h)
    assert len(set(names.values())) == len(names)


def test_a_text_longer_than_a_piece_has_the_hashes_of_its_words(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = next(iter(words.word_hashes([text])))
    monkeypatch.setattr(words, "PIECE", 200)
    pieces = list(words.word_hashes(["a b", text, None, "c"]))
    assert np.array_equal(pieces[1], whole)
    assert [len(p) for p in pieces] == [2, 3000, 0, 1]


def test_tokens_keep_case_and_signs():
    a, b, c = words.token_hashes(["Ab | ab", "| ab|", ""])
    assert len(a) == 3 and len(b) == 3 and len(c) == 0
    assert a[1] == b[0] == b[2] and a[2] == b[1] and a[0] != a[2]


def test_shingles_of_short_and_long_texts():
    long, short, empty = (words.shingles(h) for h in words.word_hashes(["a b c d e f", "a b c", ""]))
    assert len(long) == 2 and len(short) == 1 and len(empty) == 0
