"""Hashes of words and of runs of words, many texts at a time.

A word is a run of letters, marks and digits of the lower-cased text. Its hash is a
polynomial of its code points modulo 2^64, taken from running sums over the joined texts,
and mixed. Texts are handled in pieces of about ``PIECE`` characters that end at blanks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np

PIECE = 1 << 20
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_BLANK = re.compile(r"\s")
_FIRST_PRIVATE = 0x30000


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def multipliers(n: int) -> np.ndarray:
    """Fixed odd numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


@cache
def _kinds() -> np.ndarray:
    table = [1 if unicodedata.category(c)[0] in "LNM" else 2 if c.isspace() else 0 for c in map(chr, range(_FIRST_PRIVATE))]
    return np.array(table + [1], np.int8)


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + PIECE // 4)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


class Joined:
    """Code points of several texts with running sums, from which any run has its hash."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.offsets = np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)
        up, self.down = _power_tables(len(self.codes))
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(self.codes * up[: len(self.codes)], out=self.sums[1:])

    def kinds(self) -> np.ndarray:
        """1 in words, 2 in blanks, 0 elsewhere, per character."""
        return _kinds()[np.minimum(self.codes, _FIRST_PRIVATE)]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of true places."""
        padded = np.zeros(len(inside) + 2, np.int8)
        padded[1:-1] = inside
        edges = np.flatnonzero(np.diff(padded))
        return edges[0::2], edges[1::2]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def per_text(self, starts: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.searchsorted(starts, self.offsets))


def _words(texts: list[str]) -> list[np.ndarray]:
    joined = Joined([t.lower() for t in texts])
    starts, ends = joined.runs(joined.kinds() == 1)
    return joined.per_text(starts, joined.hashes(starts, ends))


def _tokens(texts: list[str]) -> list[np.ndarray]:
    joined = Joined(texts)
    kinds = joined.kinds()
    words, others = joined.runs(kinds == 1), joined.runs(kinds == 0)
    starts, ends = (np.concatenate(x) for x in zip(words, others))
    order = np.argsort(starts, kind="stable")
    return joined.per_text(starts[order], joined.hashes(starts, ends)[order])


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        blank = _BLANK.search(text, start + PIECE)
        if not blank:
            break
        yield text[start : blank.start()]
        start = blank.end()
    yield text[start:]


def in_pieces(texts: Sequence[str | None], each: Callable[[list[str]], list[np.ndarray]]) -> Iterator[np.ndarray]:
    """Apply ``each`` to lists of texts of bounded length; the pieces of a text are put together."""
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > PIECE:
            yield from each(group)
            group, size = [], 0
        if len(text) > PIECE:
            yield np.concatenate([each([p])[0] for p in _pieces(text)])
            continue
        group.append(text)
        size += len(text) + 1
    if group:
        yield from each(group)


def word_hashes(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order; None is an empty text."""
    return in_pieces(texts, _words)


def token_hashes(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words as written and of its runs of other signs."""
    return in_pieces(texts, _tokens)


def shingles(words: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """32-bit ids of the runs of ``length`` words; a shorter text is one run."""
    if len(words) == 0:
        return np.empty(0, np.uint32)
    length = min(length, len(words))
    factors = multipliers(SHINGLE)
    total = words[: len(words) - length + 1] * factors[0]
    for i in range(1, length):
        total = total + words[i : len(words) - length + 1 + i] * factors[i]
    return (mix(total) >> np.uint64(32)).astype(np.uint32)
