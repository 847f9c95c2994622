import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from failsift.llm import merkle

RNG = random.Random(6)


def prose(n):
    return " ".join(RNG.choice(["alpha", "beta", "gamma", "delta"]) + str(RNG.randint(0, 999)) for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t漢\U0001f600.", max_size=300), st.text(alphabet="ab \n.", max_size=80))
def test_leaves_cover_the_text_and_roots_tell_texts_apart(a, b):
    fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle._length(fa.partition(":")[2]) == len(a)
    assert (fa == fb) == (a == b)
    assert merkle.likeness(fa, fb) == merkle.likeness(fb, fa) and 0 <= merkle.likeness(fa, fb) <= 1
    assert (merkle.likeness(fa, fb) == 1) == (a == b)


def test_moved_branches_count_half():
    """Expected values by hand: characters in order, plus half of those moved, over all."""
    def like(a, b):
        return merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))

    assert like("a\nb\n", "b\na\n") == 0.75
    assert like("one\ntwo\nthree\n", "three\none\ntwo\n") == (8 + 0.5 * 6) / 14
    assert like("aa bb\n", "aa cc\n") == 3 / 6
    assert like("same\n", "same\n") == 1 and like("", "x") == 0 and like("a\n", "") == 0
    head, blocks = "head\n\n", [f"{c * 30} {c * 8}\n" for c in "abcdefgh"]  # 6 and 8 times 40 characters

    def text(blocks):
        return head + "".join(blocks)

    assert like(text(blocks), text(blocks[1:] + blocks[:1])) == (286 + 0.5 * 40) / 326
    assert like(text(blocks), text(blocks[:5] + blocks[6:])) == 2 * 286 / (326 + 286)
    assert like(text(blocks), text(blocks[::-1])) == (46 + 0.5 * 280) / 326


def test_the_heaviest_sequence_against_all_choices():
    for _ in range(200):
        n = RNG.randint(0, 7)
        order = RNG.sample(range(n), n)
        pairs = [((i, f"0.{RNG.randint(1, 9):x}"), (order[i], "")) for i in range(n)]
        best = 0
        for chosen in range(1 << n):
            taken = [pairs[i] for i in range(n) if chosen >> i & 1]
            if all(x[1][0] < y[1][0] for x, y in zip(taken, taken[1:])):
                best = max(best, sum(merkle._length(p[0][1]) for p in taken))
        assert merkle._in_order(pairs) == best


def test_a_root_covers_the_hashes_of_its_leaves():
    """A tree of one section, one paragraph and two pieces, hashed here by hand."""
    def digest(data):
        return hashlib.blake2b(data, digest_size=16).digest()

    leaves = [digest(b"leafalpha "), digest(b"leafbeta")]
    root = digest(b"root" + digest(b"section" + digest(b"paragraph" + b"".join(leaves))))
    assert merkle.fingerprint("alpha beta") == f"{root.hex()}:{leaves[0].hex()[:8]}.6~{leaves[1].hex()[:8]}.4"


def test_an_edit_is_located():
    paragraphs = [prose(40) for _ in range(30)]
    text = "\n".join(paragraphs)
    changed = "\n".join([*paragraphs[:12], "new " + paragraphs[12], *paragraphs[13:]])
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    ranges = merkle.differences(a, b)
    start = text.index(paragraphs[12])
    assert ranges and all(start <= low and high <= start + len(paragraphs[12]) + 1 for low, high in ranges)
    assert merkle.likeness(a, b) > 0.9 and merkle.differences(a, a) == []


def test_likeness_of_a_text_with_another_end():
    text, other = prose(300), prose(300)
    edited = text[: len(text) * 2 // 3] + other[: len(text) // 3]
    assert 0.55 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(edited)) < 0.75
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) < 0.1


def test_defined_cases(spark, docs_of):
    rows = [(3, "c"), (3, "b"), (None, "n"), (9, None), (7, ""), (-1, "x" * 300_000), (3, "b")]
    got = merkle.fingerprints(docs_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got if r.doc_id in (7, 9)}) == 1
    alone = merkle.fingerprints(docs_of([(1, "abcdef")])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 6
    assert merkle.fingerprints(docs_of([])).count() == 0


def test_neighbours_across_parts(spark, docs_of):
    rows = [(i, prose(1 + i % 7)) for i in range(500)]
    got = {r.doc_id: r for r in merkle.fingerprints(docs_of(rows).repartition(16)).collect()}
    for i, text in rows:
        following = dict(rows)[(i - 1) % 500]
        assert got[i].near_next == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(following))
