"""Toxicity: a noisy-channel decoder for disguised words, then a lexicon score.

Language model. Characters fall into ``SYMBOLS`` classes: letters a to z without marks,
other letters, and everything else as one boundary. Four-grams of classes are counted over
all documents (a table of fixed size) and smoothed with the shorter contexts.

Decoder. A span is a run of letters and of signs that can stand for letters; single characters
(signs too) with nothing but other characters between them, two or more, are one span with what
separates them. A span is decoded if it holds a letter and a place with more than one reading:
a letter is itself, or dropped if it repeats the one before it; a sign is any letter it can stand
for, itself, or dropped if it repeats the one before it; what stands between single characters
is itself or dropped. A Viterbi search over the classes of the last three characters finds the
reading of least cost under the language model and the channel. Elsewhere a text has one reading
only, itself.

Score. The restored text is looked at as a set of words and word beginnings (4 to 6 letters).
On at most ``labelled.MAX_TRAINING_DOCUMENTS`` labelled documents those that speak for
toxicity beyond chance (log-likelihood ratio) become the lexicon, up to ``LEXICON`` entries,
and a logistic regression over the entries present gives the score. Fit and scores depend on
the texts alone.

Defined cases: a null text is empty; a text without lexicon entries, the empty one too, gets
the score of the regression's constant. Null ids count as held out. Without toxic labels, or
without others, no entry is chosen and the score is the share of label 1 in the sample (0
without labels). Every row gives a row, repeated ones too. No rows give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import dataclasses
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.labelled import training_documents
from failsift.llm.quality import accepted, score
from failsift.llm.tables import arrays, small_batches, stored
from failsift.llm.words import Joined, in_pieces, mix, multipliers

THRESHOLD = 0.7
SYMBOLS = 28  # boundary, a to z, other letters
ORDER = 4
SMOOTHING = 4.0
PREFIXES = (4, 5, 6)
LEXICON = 2048
LEAST_RATIO = 20.0  # log-likelihood ratio of an entry
LEAST_DOCUMENTS = 3
DROP_REPEAT, DROP_SEPARATOR, READ_SIGN = 3.0, 0.5, 1.0
MEMORY, REMEMBERED = 50_000, 256  # decoded spans that a worker remembers, and their greatest length

# Letters that a sign can stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_NO_LETTERS = 0x34000  # from here on


@cache
def _classes() -> np.ndarray:
    def kind(c: str) -> int:
        plain = unicodedata.normalize("NFD", c.lower())[0]
        if "a" <= plain <= "z":
            return ord(plain) - 96
        return 27 if c.isalpha() else 0

    return np.array([kind(chr(i)) for i in range(0x3000)] + [27], np.int64)


def classes(codes: np.ndarray) -> np.ndarray:
    return _classes()[np.minimum(codes, 0x3000)]


@cache
def class_of(char: str) -> int:
    return int(classes(np.array([ord(char)]))[0])


@cache
def _forms() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 1 for letters, 2 for other digits and numbers, 0 elsewhere; whether it is a sign."""
    form = np.array([1 if c.isalpha() else 2 if c.isalnum() else 0 for c in map(chr, range(_NO_LETTERS))] + [0], np.int8)
    return form, np.isin(np.arange(_NO_LETTERS + 1), [ord(c) for c in READINGS])


def four_grams(docs: DataFrame) -> np.ndarray:
    """Counts of all four-grams of classes, runs of boundaries taken as one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)

        def add(texts: list[str]) -> list[np.ndarray]:
            c = classes(np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4"))
            c = np.concatenate(([0, 0], c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]))
            grams = ((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:]
            total[:] += np.bincount(grams, minlength=len(total))
            return [np.empty(0)] * len(texts)

        for batch in batches:
            for _ in in_pieces(batch.column(0).to_pylist(), add):
                pass
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["gram", "n"])

    rows = arrays(docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    counts = np.zeros(SYMBOLS**ORDER)
    counts[rows["gram"]] = rows["n"]
    return counts


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(class | three classes before it), flat, from counts of four-grams."""
    grams = counts.reshape((SYMBOLS,) * ORDER)
    probability = np.full(SYMBOLS, 1 / SYMBOLS)
    for left in range(ORDER - 1, -1, -1):
        seen = grams.sum(axis=tuple(range(left))) if left else grams
        probability = (seen + SMOOTHING * probability) / (seen.sum(axis=-1, keepdims=True) + SMOOTHING)
    return np.log(probability).reshape(-1)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """The readings of each character, with their costs; an empty reading drops it."""
    n = len(span)
    word = [False, *(c.isalnum() for c in span), False]  # word[i + 1] is for span[i]
    # Whether the last character of a word before each place, and the first one after it, stands alone.
    before, after, alone = [True] * n, [True] * n, True
    for i in range(n):
        before[i] = alone
        if word[i + 1]:
            alone = not word[i]
    alone = True
    for i in reversed(range(n)):
        after[i] = alone
        if word[i + 1]:
            alone = not word[i + 2]
    places = []
    for i, c in enumerate(span):
        readings = [(c, 0.0)]
        readings += [(letter, READ_SIGN) for letter in READINGS.get(c, "")]
        if i and c == span[i - 1] and (c.isalpha() or c in READINGS):
            readings.append(("", DROP_REPEAT if c != span[i - 2 : i - 1] else DROP_REPEAT / 4))
        if 0 < i < n - 1 and not word[i + 1] and before[i] and after[i]:
            # Several separators in a row cost as much as one.
            further = c not in READINGS and not word[i] and span[i - 1] not in READINGS
            readings.append(("", 0.0 if further else DROP_SEPARATOR))
        places.append(readings)
    return places


def decode(span: str, log_p: list[float]) -> str:
    """The reading of ``span`` with the least cost, as a word between boundaries."""
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    width = SYMBOLS ** (ORDER - 1)
    for readings in lattice(span):
        options = [(letter, cost, class_of(letter) if letter else -1) for letter, cost in readings]
        following: dict[int, tuple[float, tuple]] = {}
        for state, (paid, path) in states.items():
            for letter, cost, kind in options:
                total, reached = paid + cost, state
                if kind > 0 or (kind == 0 and state % SYMBOLS):
                    gram = state * SYMBOLS + kind
                    total -= log_p[gram]
                    reached = gram % width
                known = following.get(reached)
                if known is None or total < known[0]:
                    following[reached] = (total, (path, letter) if letter else path)
        states = following
    ends = {state: paid - (log_p[state * SYMBOLS] if state % SYMBOLS else 0.0) for state, (paid, _) in states.items()}
    least = min(ends.values())
    return min(_spell(states[state][1]) for state, cost in ends.items() if cost == least)


def _spell(path: tuple) -> str:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edges[0::2], edges[1::2]


def spans(texts: list[str]) -> list[np.ndarray]:
    """Per lower-cased text, (start, end) of the spans that hold a letter and a place with several readings."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    n = len(codes)
    form, signs = (t[np.minimum(codes, _NO_LETTERS)] for t in _forms())
    letter = form == 1
    word = np.zeros(n + 2, bool)
    word[1:-1] = form > 0
    wide = np.zeros(n + 2, bool)  # in words of two characters or more
    wide[1:-1] = word[1:-1] & (word[:-2] | word[2:])
    # Places that stand alone: single characters, and runs of signs that touch no wider word.
    alone = word[1:-1] & ~wide[1:-1]
    starts, ends = _runs(signs & ~word[1:-1])
    free = ~(wide[starts] | wide[ends + 1])
    change = np.zeros(n + 1, np.int8)
    change[starts[free]] += 1
    change[ends[free]] -= 1
    alone |= np.cumsum(change[:-1], dtype=np.int8) > 0
    stop = wide[1:-1].copy()
    stop[offsets[1:-1] - 1] = True
    marks = np.flatnonzero(alone | stop)
    joins = np.flatnonzero(alone[marks[:-1]] & alone[marks[1:]] & (np.diff(marks) > 1)) if len(marks) else marks
    change[:] = 0
    change[marks[joins]] += 1
    change[marks[joins + 1] + 1 if len(joins) else joins] -= 1
    joined = np.cumsum(change[:-1], dtype=np.int8) > 0
    several = signs | joined
    several[1:] |= letter[1:] & (codes[1:] == codes[:-1])
    starts, ends = _runs(letter | signs | joined)
    count = lambda inside: np.concatenate(([0], np.cumsum(inside)))
    letters, places = count(letter), count(several)
    chosen = (letters[ends] > letters[starts]) & (places[ends] > places[starts])
    starts, ends = starts[chosen], ends[chosen]
    cuts = np.searchsorted(starts, offsets)
    return [np.stack([starts[i:j], ends[i:j]], axis=1) - o for i, j, o in zip(cuts[:-1], cuts[1:], offsets)]


class Restorer:
    """Restores lower-cased texts; remembers a bounded number of decoded spans."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p.tolist()
        self.known: dict[str, str] = {}

    def _read(self, span: str) -> str:
        read = self.known.get(span)
        if read is None:
            read = decode(span, self.log_p)
            if len(span) <= REMEMBERED:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[span] = read
        return read

    def restore(self, texts: list[str]) -> list[str]:
        lowered, restored = [t.lower() for t in texts], []
        for text, found in zip(lowered, spans(lowered)):
            parts, last = [], 0
            for start, end in found.tolist():
                parts += (text[last:start], self._read(text[start:end]))
                last = end
            restored.append("".join(parts) + text[last:] if parts else text)
        return restored


def word_features(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words and word beginnings of each lower-cased text, repeats included."""
    joined = Joined(texts)
    starts, ends = joined.runs(joined.kinds() == 1)
    places, hashes = [starts], [joined.hashes(starts, ends)]
    for k, length in enumerate(PREFIXES):
        longer = ends - starts > length
        places.append(starts[longer])
        hashes.append(mix(joined.hashes(starts[longer], starts[longer] + length) + multipliers(8)[k]))
    place, feature = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(place, kind="stable")
    return joined.per_text(place[order], feature[order])


@dataclasses.dataclass
class Toxicity:
    """log_p: language model; entries: sorted hashes; weights and constant of the regression."""

    log_p: np.ndarray
    entries: np.ndarray
    weights: np.ndarray
    constant: float

    def __post_init__(self):
        self.restorer = None
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.entries >> np.uint64(48)).astype(np.intp)] = True

    def features(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if self.restorer is None:
            self.restorer = Restorer(self.log_p)
        return in_pieces(texts, lambda group: word_features(self.restorer.restore(group)))

    def present(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Places in the lexicon of the entries that each text holds."""
        for hashes in self.features(texts):
            some = hashes[self.maybe[(hashes >> np.uint64(48)).astype(np.intp)]]
            at = np.searchsorted(self.entries, some)
            at = np.minimum(at, max(0, len(self.entries) - 1))
            yield np.unique(at[self.entries[at] == some]) if len(self.entries) else np.empty(0, np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits = np.array([self.constant + self.weights[p].sum() for p in self.present(texts)], float)
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def lexicon(sample: DataFrame, log_p) -> np.ndarray:
    """The entries that speak for label 1, by their numbers of documents in the sample."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(log_p.value, np.empty(0, np.uint64), np.empty(0), 0.0)
        for batch in batches:
            label = np.array(batch.column("label").to_pylist())
            per_doc = [np.unique(h) for h in model.features(batch.column("text").to_pylist())]
            feature = np.concatenate(per_doc) if per_doc else np.empty(0, np.uint64)
            toxic = np.repeat(label, [len(h) for h in per_doc]) == 1
            distinct, inverse = np.unique(feature, return_inverse=True)
            ones = np.bincount(inverse, weights=toxic, minlength=len(distinct)).astype(np.int64)
            both = np.bincount(inverse, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(ones, pa.int64()), pa.array(both - ones, pa.int64())],
                ["feature", "ones", "zeros"],
            )

    ones, zeros = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not ones or not zeros:
        return np.empty(0, np.uint64)
    counts = sample.mapInArrow(gather, "feature long, ones long, zeros long").groupBy("feature").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")
    )
    # A feature can pass the log-likelihood ratio only if label 1 is commoner with it than without.
    total, rate = ones + zeros, F.col("ones") / (F.col("ones") + F.col("zeros"))
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    held = F.col("ones") + F.col("zeros")
    ratio = 2 * (
        term(F.col("ones"), held * ones / total)
        + term(F.col("zeros"), held * zeros / total)
        + term(ones - F.col("ones"), (total - held) * ones / total)
        + term(zeros - F.col("zeros"), (total - held) * zeros / total)
    )
    best = (
        counts.where((F.col("ones") >= LEAST_DOCUMENTS) & (rate > ones / total))
        .select("feature", ratio.alias("ratio"))
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.col("ratio").desc(), "feature")
        .limit(LEXICON)
    )
    return np.sort(arrays(best)["feature"].view(np.uint64))


def fit_regression(present: list[np.ndarray], label: np.ndarray, entries: int) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression over the entries present."""
    rate = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 1e-6
    weights, constant = np.zeros(entries), float(np.log(rate / (1 - rate)))
    if entries == 0:
        return weights, constant if len(label) else -40.0
    doc = np.repeat(np.arange(len(present)), [len(p) for p in present])
    entry = np.concatenate(present).astype(np.intp)
    moment, moment_c, square, square_c = np.zeros(entries), 0.0, np.zeros(entries), 0.0
    for step in range(1, 401):
        logit = constant + np.bincount(doc, weights=weights[entry], minlength=len(label))
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label) / len(label)
        grad = np.bincount(entry, weights=error[doc], minlength=entries) + 1e-5 * weights
        grad_c = error.sum()
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        moment_c, square_c = 0.9 * moment_c + 0.1 * grad_c, 0.99 * square_c + 0.01 * grad_c**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weights = weights - 0.05 * (moment / fix) / (np.sqrt(square / fix2) + 1e-7)
        constant -= 0.05 * (moment_c / fix) / (np.sqrt(square_c / fix2) + 1e-7)
    return weights, float(constant)


def train(docs: DataFrame, labels: DataFrame) -> Toxicity:
    small_batches(docs.sparkSession)
    log_p = log_probabilities(four_grams(docs)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(log_p)
    sample = stored(training_documents(docs, labels, "toxic").dropDuplicates(["id"]), "toxic-sample")
    entries = lexicon(sample, shared)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(shared.value, entries, np.zeros(len(entries)), 0.0)
        for batch in batches:
            places = [p.astype(np.int32) for p in model.present(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(places, pa.list_(pa.int32()))], ["id", "label", "places"]
            )

    rows = sample.mapInArrow(find, "id long, label int, places array<int>").orderBy("id").toArrow()
    present = [np.asarray(p, np.intp) for p in rows.column("places").to_pylist()]
    weights, constant = fit_regression(present, rows.column("label").to_numpy().astype(float), len(entries))
    return Toxicity(log_p, entries, weights, constant)


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not call toxic, with all columns."""
    return accepted(docs, train(docs, labels), lambda s: s < THRESHOLD)
