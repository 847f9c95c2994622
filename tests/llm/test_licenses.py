import textwrap

import pytest

from failsift.llm.licenses import TEMPLATES, scan_licences, template_bigrams


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_templates_match_themselves_and_near_forms(docs_of):
    names = sorted(TEMPLATES)
    docs = docs_of([(i, f"Some prose before it.\n{TEMPLATES[n]}\nand after.") for i, n in enumerate(names)])
    got = rows_of(scan_licences(docs))
    assert {i: (r.licence, r.score) for i, r in got.items()} == {i: (n, 1.0) for i, n in enumerate(names)}
    changed = TEMPLATES["mit-grant"].replace("free of charge", "FREE of all charge")
    row = rows_of(scan_licences(docs_of([(1, changed)])))[1]
    mine, theirs = set(template_bigrams(changed)), set(template_bigrams(TEMPLATES["mit-grant"]))
    assert row.licence == "mit-grant" and row.score == pytest.approx(2 * len(mine & theirs) / (len(mine) + len(theirs)))


def test_defined_cases(docs_of):
    docs = docs_of(
        [(1, None), (2, ""), (3, "word"), (4, "All rights reserved."), (4, "All rights reserved."), (None, "all RIGHTS -- reserved"), (5, "x y " * 50_000)]
    )
    got = sorted((r.doc_id or 0, r.licence, r.score, r.matches, r.licences) for r in scan_licences(docs).collect())
    found = ("all-rights-reserved", 1.0, 1, "all-rights-reserved")
    none = (None, 0.0, 0, "")
    assert got == [(0, *found), (1, *none), (2, *none), (3, *none), (4, *found), (4, *found), (5, *none)]
    assert scan_licences(docs.limit(0)).count() == 0


def test_equal_scores_go_to_the_first_name(docs_of):
    templates = {"b": "one two three", "a": "one two four"}
    got = scan_licences(docs_of([(1, "one two")]), templates, 0.6).first()
    assert (got.licence, round(got.score, 3)) == ("a", 0.667)


@pytest.mark.parametrize("width, prefix", [(40, ""), (60, " * "), (72, "# ")])
def test_a_notice_wrapped_over_lines_in_a_longer_document_is_found(docs_of, width, prefix):
    before, after = ("".join(f"def {x}{i} of the mill {i}\n" for i in range(60)) for x in "ab")
    rows = []
    for i, name in enumerate(sorted(TEMPLATES)):
        wrapped = "".join(f"{prefix}{line}\n" for line in textwrap.wrap(TEMPLATES[name], width, break_long_words=False))
        rows.append((i, before + wrapped + after))
    got = rows_of(scan_licences(docs_of(rows)))
    assert [(got[i].licence, got[i].score) for i, _ in rows] == [(n, 1.0) for n in sorted(TEMPLATES)]


def test_a_notice_within_a_line_is_found_and_counted_once(docs_of):
    words, mit, grant = "some plain words of prose " * 60, TEMPLATES["mit"], TEMPLATES["mit-grant"]
    docs = docs_of([(1, words + mit), (2, f"{words}\n{mit}\n{mit}\n{words}"), (3, f"{mit}\n{words}{grant} {words}{mit}"), (4, words)])
    got = {i: (r.licence, r.score, r.matches, r.licences) for i, r in rows_of(scan_licences(docs)).items()}
    assert got == {1: ("mit", 1.0, 1, "mit"), 2: ("mit", 1.0, 2, "mit"), 3: ("mit", 1.0, 3, "mit,mit-grant"), 4: (None, 0.0, 0, "")}


def test_texts_full_of_notices_are_scanned(docs_of):
    """The text of 8,000 notices is 2.4 million characters; pairs of notices would be 32 million."""
    grant, mit = TEMPLATES["mit-grant"], TEMPLATES["mit"]
    for n in (80, 800, 8000):
        lines, wrapped = "\n".join([mit] * n), " ".join(f"{grant} then part {i} of file {i} goes on" for i in range(n // 4))
        got = rows_of(scan_licences(docs_of([(1, lines), (2, wrapped)])))
        assert (got[1].licence, got[1].score, got[1].matches, got[1].licences) == ("mit", 1.0, n + 1, "mit")
        assert (got[2].licence, got[2].score, got[2].licences) == ("mit-grant", 1.0, "mit-grant")
        assert got[2].matches == n // 4


def test_words_put_in_or_left_out_move_the_rest_of_a_window(docs_of):
    plain = " ".join(f"plain words of part {i}" for i in range(60))
    words = TEMPLATES["mit-grant"].split()
    put_in = " ".join(words[:30] + ["as", "stated"] + words[30:])
    left_out = " ".join(words[:20] + words[23:])
    replaced = " ".join(["x" if i in (7, 41) else w for i, w in enumerate(words)])
    for i, form in enumerate((put_in, left_out, replaced)):
        row = scan_licences(docs_of([(i, f"{plain} {form} {plain}")])).first()
        mine, own = set(template_bigrams(form)), set(template_bigrams(TEMPLATES["mit-grant"]))
        assert (row.licence, row.matches) == ("mit-grant", 1)
        assert row.score == pytest.approx(2 * len(mine & own) / (len(mine) + len(own)))
