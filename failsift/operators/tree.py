"""Searches as small trees, evaluated over normalised logs or over the inverted index.

Leaves are phrases of any number of tokens, prefixes, phrases at the start of a log and
phrases near each other; inner nodes are All, Either and But. A leaf without a token
matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failsift.functions.text import terms_of
from failsift.operators import index as ix
from failsift.operators import search


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Prefix:
    text: str


@dataclass(frozen=True)
class Initial:
    text: str


@dataclass(frozen=True)
class Near:
    texts: tuple[str, ...]
    distance: int = ix.NEAR_DISTANCE


@dataclass(frozen=True)
class All:
    parts: tuple[Tree, ...]


@dataclass(frozen=True)
class Either:
    parts: tuple[Tree, ...]


@dataclass(frozen=True)
class But:
    wanted: Tree
    unwanted: Tree


Tree = Phrase | Prefix | Initial | Near | All | Either | But

_LEAVES = {
    Phrase: (search.phrase, ix.jobs_with_phrase),
    Prefix: (search.prefix, ix.jobs_with_prefix_phrase),
    Initial: (search.initial, ix.jobs_with_initial),
}


def _children(tree: Tree) -> tuple[Tree, ...]:
    return (tree.wanted, tree.unwanted) if isinstance(tree, But) else getattr(tree, "parts", ())


def has_near(tree: Tree) -> bool:
    """Such a tree needs positions and cannot be one condition over a text."""
    return isinstance(tree, Near) or any(map(has_near, _children(tree)))


def exact_terms(tree: Tree) -> set[str] | None:
    """The terms whose index rows suffice, or None if a prefix needs others too."""
    if isinstance(tree, Prefix):
        return None
    if isinstance(tree, (Phrase, Initial, Near)):
        return {t for text in (tree.texts if isinstance(tree, Near) else (tree.text,)) for t in terms_of(text)}
    below = [exact_terms(c) for c in _children(tree)]
    return None if None in below else set().union(*below)


def condition(tree: Tree) -> Column:
    """The tree as a condition over ``norm``."""
    if type(tree) in _LEAVES:
        return _LEAVES[type(tree)][0](tree.text) if terms_of(tree.text) else F.lit(False)
    if isinstance(tree, But):
        return search.but_not(condition(tree.wanted), condition(tree.unwanted))
    if isinstance(tree, Near):
        raise ValueError("phrases near each other need the index")
    return (search.all_of if isinstance(tree, All) else search.any_of)(*map(condition, tree.parts))


def jobs_in_index(tree: Tree, index: DataFrame) -> DataFrame:
    """Ids of the jobs that meet the tree; every leaf reads the rows of its terms only."""
    if type(tree) in _LEAVES:
        if not terms_of(tree.text):
            return index.where(F.lit(False)).select("job_id")
        return _LEAVES[type(tree)][1](index, tree.text)
    if isinstance(tree, Near):
        if not all(map(terms_of, tree.texts)):
            return index.where(F.lit(False)).select("job_id")
        return ix.jobs_with_near(index, *tree.texts, distance=tree.distance)
    below = [jobs_in_index(c, index) for c in _children(tree)]
    if isinstance(tree, Either):
        return reduce(DataFrame.union, below).distinct()
    how = "left_anti" if isinstance(tree, But) else "left_semi"
    return reduce(lambda a, b: a.join(b, "job_id", how), below)


def jobs_in_logs(tree: Tree, logs: DataFrame) -> DataFrame:
    """The same over logs, without a stored index."""
    return jobs_in_index(tree, ix.term_rows(logs)) if has_near(tree) else search.matches(logs, condition(tree))
