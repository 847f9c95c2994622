"""Token rule of the log index: case and Latin accents folded, split at everything
that is not a letter, a number or a private-use character."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


def _latin_folds() -> dict[str, str]:
    """Lower-case letters with exactly one diacritic, mapped to the bare letter, and the
    combining marks that make them, mapped to nothing.

    Built from the Unicode decompositions; letters whose base is itself composed
    carry two diacritics and stay as they are, as do ß, ø and ł.
    """
    letters, marks = {}, {}
    for code in chain(range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.decomposition(letter).split()
        if len(parts) != 2 or parts[0].startswith("<"):
            continue
        base, mark = (chr(int(p, 16)) for p in parts)
        marks[mark] = ""
        if letter == letter.lower() and not unicodedata.decomposition(base):
            letters[letter] = base
    # The sigma that ends a word is the same letter.
    return letters | {"ς": "σ"} | marks


_FOLDS = _latin_folds()


def normalise(log: Column) -> Column:
    """The log as space-separated tokens with a space at both ends."""
    ascii_only = F.octet_length(log) == F.char_length(log)
    plain = F.regexp_replace(F.lower(log), "[^a-z0-9]+", " ")
    # Characters without a counterpart, here the marks at the end, are removed.
    bare = F.translate(F.lower(log), "".join(_FOLDS), "".join(_FOLDS.values()))
    folded = F.regexp_replace(bare, _SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(F.when(ascii_only, plain).otherwise(folded)), F.lit(" "))


def tokens(norm: Column) -> Column:
    """The tokens of a normalised log, in order; one empty token for an empty log."""
    return F.split(F.trim(norm), " ")


def terms_of(text: str) -> list[str]:
    """Tokens of a short search text, by the same rule as :func:`normalise`."""
    folded = "".join(_FOLDS.get(c, c) for c in text.lower())
    kinds = ((c, unicodedata.category(c)) for c in folded)
    return "".join(c if kind[0] in "LN" or kind == "Co" else " " for c, kind in kinds).split()
