"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

The words of a corpus are counted (``corpus_words``). Two words are near if one inserted,
deleted or replaced code point makes one of the other. Then the counts of their letters differ
by 1 in all (lengths L and L + 1) or by 2 (equal lengths), so near words are close points.

1. ``top_trees``: for each length a k-d tree of the space, its splits taken from a sample of
   at most ``MAX_SAMPLE`` words. The sample shapes the leaves only; every word is placed.
2. ``dealt``: a leaf is a block. A word goes to its own block as a point, and as a query to the
   blocks of lengths L - 1, L and L + 1 whose box lies within the distance, so each ordered
   pair of near words meets in one block.
3. ``Block``: in a task a k-d tree of a block's points is searched by its queries as they stream
   in. Boxes too far away are pruned, letter counts compared in leaves, and the order of
   letters is verified on the words. A leaf of many words with equal counts (anagrams) is
   searched by patterns of words with one place left out, which takes no pairs.
4. Per query and block one row leaves a task: how many words are near, and the commonest.

``variants`` gives each word its form (the commonest near word, if ``TIMES`` as common) and the
root at the end of the forms. Counts grow along forms, so a chain has at most 27 steps and
doubling steps find its end in five rounds.

Defined cases: null text has no words; a null doc_id counts as the text ``null``. Equal counts
of near words give the smallest by code points. A repeated row counts again. Words of any
length are compared whole. No words give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.tables import arrays, stored
from failsift.llm.words import multipliers

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
DELETE_EVERY = 199
# Words in a block, in a leaf of its tree, and searched at once.
BLOCK_WORDS = 8_192
LEAF_WORDS = 64
QUERIES_AT_ONCE = 8_192
# Words that shape the top trees, and how many of them for each block.
MAX_SAMPLE = 1 << 18
SAMPLE_PER_BLOCK = 64
# A leaf this large holds equal letter counts only.
LARGE_LEAF = 512
_LETTERS = 26 + 64
_ROUNDS = 5

DEALT = "length int, leaf int, visitor int, word string, n long"
FOUND = "word string, near long, best_n long, best string"


def corpus_words(docs: DataFrame) -> DataFrame:
    """word, n: the counted words of all texts, with some letters left out as the module's contract says."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # a shorter run cannot give a word that counts
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = run.select("run", h.alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def letter_counts(places: np.ndarray) -> np.ndarray:
    """A point per word: how often each letter occurs. Other signs than the letters share places with them."""
    letter = np.where(places < 128, places - ord("a"), places - 0xC0 + 26) % _LETTERS
    cell = np.arange(len(places))[:, None] * _LETTERS + letter
    counts = np.bincount(cell.ravel(), minlength=len(places) * _LETTERS).reshape(len(places), _LETTERS)
    # squares of the counts stay exact
    return counts.astype(np.float32 if places.shape[1] < 1_000 else np.float64)


def kd_tree(points: np.ndarray, rows: np.ndarray, leaf_size: int) -> tuple:
    """Nested (letter, highest count on the left, left, right), with leaves (rows,)."""
    if len(rows) > leaf_size:
        some = points[rows]
        letter = int(np.argmax(some.var(axis=0)))
        values = some[:, letter]
        middle = np.median(values)
        cuts = [c for c in (np.floor(middle), np.ceil(middle) - 1) if values.min() <= c < values.max()]
        if cuts:
            cut = min(cuts, key=lambda c: abs(2 * (values <= c).sum() - len(values)))
            left = values <= cut
            return letter, float(cut), kd_tree(points, rows[left], leaf_size), kd_tree(points, rows[~left], leaf_size)
    return (rows,)


def range_search(tree: tuple, points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the queries, leaf) for the leaves whose box lies within ``radius`` (sum of differences) of a query."""

    def visit(node, rows, gap, low, high):
        if not len(rows):
            return
        if len(node) == 1:
            yield rows, node[0]
            return
        letter, cut, left, right = node
        value = points[rows, letter]
        lo, hi = low.get(letter, 0.0), high.get(letter, np.inf)
        rest = gap - np.maximum(np.maximum(lo - value, value - hi), 0)
        to_left = rest + np.maximum(np.maximum(lo - value, value - cut), 0)
        to_right = rest + np.maximum(np.maximum(cut + 1 - value, value - hi), 0)
        near = to_left <= radius
        yield from visit(left, rows[near], to_left[near], low, high | {letter: cut})
        near = to_right <= radius
        yield from visit(right, rows[near], to_right[near], low | {letter: cut + 1}, high)

    yield from visit(tree, np.arange(len(points)), np.zeros(len(points)), {}, {})


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of each row differ by one edit; ``b`` is as long as ``a`` or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def patterns(places: np.ndarray, gap: bool) -> np.ndarray:
    """Hashes of the words with each place left out, closed up or (``gap``) kept as a gap; with its number."""
    factors = multipliers(places.shape[1])
    terms = places.astype(np.uint64) * factors
    if gap:
        return terms.sum(axis=1, dtype=np.uint64)[:, None] - terms + np.arange(1, len(factors) + 1, dtype=np.uint64) * multipliers(1)
    moved = places[:, 1:].astype(np.uint64) * factors[:-1]
    head = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    tail = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    head[:, :-1] += tail
    return head


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (rows of hashes) that share a hash, each pair once."""
    order = np.argsort(b, axis=None, kind="stable")
    keys = b.ravel()[order]
    start, end = (np.searchsorted(keys, a.ravel(), side) for side in ("left", "right"))
    n = end - start
    row = np.repeat(np.arange(a.size) // a.shape[1], n)
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    pairs = np.unique(row * len(b) + order[at] // b.shape[1])
    return pairs // max(len(b), 1), pairs % max(len(b), 1)


class Block:
    """Points of one length with their tree; words go by code points, so the first of equals is the smallest."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n, self.codes = words, n, codes(words)
        self.points = letter_counts(self.codes)
        self.squares = (self.points**2).sum(axis=1)
        self.tree = kd_tree(self.points, np.arange(len(words)), LEAF_WORDS)

    def near(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all words one edit apart."""
        length = self.codes.shape[1]
        apart = 2 if places.shape[1] == length else 1
        points = letter_counts(places)
        squares = (points**2).sum(axis=1)
        queries, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows, leaf in range_search(self.tree, points, apart):
            if len(leaf) > LARGE_LEAF:
                i, j = self.by_pattern(places[rows], leaf)
                i = rows[i]
            else:
                # differences of 1 in one or two letters have these sums of squares, and no others do
                distance = squares[rows][:, None] + self.squares[leaf] - 2 * points[rows] @ self.points[leaf].T
                i, j = np.nonzero(distance == apart)
                i, j = rows[i], leaf[j]
            a, b = (places[i], self.codes[j]) if places.shape[1] <= length else (self.codes[j], places[i])
            same = one_edit(a, b)
            queries.append(i[same])
            found.append(j[same])
        return np.concatenate(queries), np.concatenate(found)

    def by_pattern(self, places: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.codes[leaf]
        if places.shape[1] == own.shape[1]:
            i, j = meeting(patterns(places, gap=True), patterns(own, gap=True))
        else:
            whole = lambda p: (p.astype(np.uint64) * multipliers(p.shape[1])).sum(axis=1, dtype=np.uint64)[:, None]
            cut = lambda p: patterns(p, gap=False)
            i, j = meeting(whole(places), cut(own)) if places.shape[1] < own.shape[1] else meeting(cut(places), whole(own))
        return i, leaf[j]

    def summed(self, words: list[str]) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words, count of the commonest, the commonest) of the queries that are near any."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for group in by_length.values():
            query, point = self.near(codes(group))
            order = np.lexsort((point, -self.n[point], query))
            query, point = query[order], point[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            for q, p, near in zip(query[first], point[first], np.diff(first, append=len(query))):
                yield group[q], int(near), int(self.n[p]), self.words[p]


def top_trees(vocabulary: DataFrame, block_words: int) -> dict[int, tuple]:
    """For each length that occurs, a tree with numbered leaves."""
    lengths = arrays(vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")))
    total = int(lengths["n"].sum()) if len(lengths["n"]) else 0
    wanted = min(MAX_SAMPLE, max(1, total // block_words) * SAMPLE_PER_BLOCK)
    every = max(1, total // wanted)
    sample = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").limit(2 * MAX_SAMPLE)
    chosen: dict[int, list[str]] = {}
    for word in sample.toArrow().column("word").to_pylist():
        chosen.setdefault(len(word), []).append(word)
    trees = {}
    for length, n in zip(lengths["length"], lengths["n"]):
        words = chosen.get(int(length), [])
        size = max(1, len(words) * block_words // int(n))
        points = letter_counts(codes(words)) if words else np.zeros((0, _LETTERS))
        number = iter(range(len(words) + 1))
        trees[int(length)] = _numbered(kd_tree(points, np.arange(len(words)), size), number)
    return trees


def _numbered(node: tuple, number: Iterator[int]) -> tuple:
    if len(node) == 1:
        return (next(number),)
    return *node[:2], _numbered(node[2], number), _numbered(node[3], number)


def dealt(vocabulary: DataFrame, trees: dict[int, tuple]) -> DataFrame:
    """length, leaf, visitor, word, n: each word in its own block (visitor 0) and in those it has to search (1)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                points = letter_counts(codes(list(words[rows])))
                for other, radius in ((length, 0), (length, 2), (length - 1, 1), (length + 1, 1)):
                    if int(other) not in trees:
                        continue
                    for some, leaf in range_search(trees[int(other)], points, radius):
                        chosen = rows[some]  # a word searches its own block as a visitor, too
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(chosen), other, np.int32)),
                                pa.array(np.full(len(chosen), leaf, np.int32)),
                                pa.array(np.full(len(chosen), int(radius > 0), np.int32)),
                                pa.array(list(words[chosen]), pa.string()),
                                pa.array(n[chosen]),
                            ],
                            names=["length", "leaf", "visitor", "word", "n"],
                        )

    return vocabulary.select("word", "n").mapInArrow(deal, DEALT)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from rows sorted by (length, leaf, visitor, word): points first, then queries as they come."""
    at, points, counts, block, waiting = None, [], [], None, []

    def search():
        nonlocal block
        if points and waiting:
            block = block or Block(points, np.array(counts))
            if found := list(block.summed(waiting)):
                yield pa.RecordBatch.from_pydict(dict(zip(("word", "near", "best_n", "best"), map(list, zip(*found)))))

    for batch in batches:
        for length, leaf, visitor, word, n in zip(*[batch.column(k).to_pylist() for k in ("length", "leaf", "visitor", "word", "n")]):
            if (length, leaf) != at:
                yield from search()
                at, points, counts, block, waiting = (length, leaf), [], [], None, []
            if visitor:
                waiting.append(word)
                if len(waiting) >= QUERIES_AT_ONCE:
                    yield from search()
                    waiting = []
            else:
                points.append(word)
                counts.append(n)
    yield from search()


def near_words(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, best (struct of n and word): of the words of (word, n) that have near ones."""
    rows = dealt(vocabulary, top_trees(vocabulary, block_words))
    searched = (
        rows.repartition("length", "leaf")
        .sortWithinPartitions("length", "leaf", "visitor", "word")
        .mapInArrow(_searched, FOUND)
    )
    best = F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word")))
    return searched.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the ends of the chains (word, form), each step doubled."""
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(_ROUNDS):
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = stored(
            found.join(step, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if found.where("moved").isEmpty():
            break
        found = found.select("word", "root")
    return found.select("word", "root")


def variants(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the distinct words of (word, n)."""
    words = stored(vocabulary, "spelling-words")
    near = near_words(words, block_words)
    form_n = -F.col("best.minus_n")
    formed = form_n >= F.col("n") * TIMES
    grouped = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(formed, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, form_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(grouped.where("form IS NOT NULL"))
    return grouped.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
