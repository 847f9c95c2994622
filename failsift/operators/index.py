"""The inverted index (term, job_id, pos) and look-ups that read only its terms.

A look-up starts with a filter on the term, which prunes the stored index to a
few files. What follows groups by job, or by job and position, and every group
is merged before the shuffle or cut into blocks, so that one huge log does not
end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failsift.functions.text import terms_of, tokens
from failsift.operators.search import with_norm

NEAR_DISTANCE = 10
_BLOCK = 1 << 16


def term_rows(logs: DataFrame) -> DataFrame:
    """One row per token of every log, with its position."""
    rows = logs if "norm" in logs.columns else with_norm(logs)
    return (
        rows.select("job_id", F.posexplode(tokens(F.col("norm"))).alias("pos", "term"))
        .where(F.col("term") != "")
        .select("term", "job_id", "pos")
    )


def _single_terms(texts: Sequence[str]) -> list[str]:
    terms = [terms_of(t) for t in texts]
    if not terms or any(len(t) != 1 for t in terms):
        raise ValueError("each text must be exactly one token")
    return [t[0] for t in terms]


def _jobs_where(index: DataFrame, texts: Sequence[str], rule) -> DataFrame:
    terms = _single_terms(texts)
    flags = [F.bool_or(F.col("term") == t).alias(f"has_{i}") for i, t in enumerate(terms)]
    per_job = index.where(F.col("term").isin(terms)).groupBy("job_id").agg(*flags)
    return per_job.where(rule([F.col(f"has_{i}") for i in range(len(terms))])).select("job_id")


def jobs_with_all(index: DataFrame, *texts: str) -> DataFrame:
    return _jobs_where(index, texts, lambda has: reduce(lambda a, b: a & b, has))


def jobs_with_any(index: DataFrame, *texts: str) -> DataFrame:
    return index.where(F.col("term").isin(_single_terms(texts))).select("job_id").distinct()


def jobs_with_but_not(index: DataFrame, wanted: str, unwanted: str) -> DataFrame:
    return _jobs_where(index, [wanted, unwanted], lambda has: has[0] & ~has[1])


def jobs_with_prefix(index: DataFrame, text: str) -> DataFrame:
    return index.where(F.col("term").startswith(_single_terms([text])[0])).select("job_id").distinct()


def jobs_with_prefix_phrase(index: DataFrame, text: str) -> DataFrame:
    """Jobs with the tokens in sequence, the last of them as the beginning of a token."""
    return _phrase_starts(index, [_phrase_terms(text)], open_end=True).select("job_id").distinct()


def jobs_with_phrase(index: DataFrame, *texts: str) -> DataFrame:
    return _phrase_starts(index, [_phrase_terms(" ".join(texts))]).select("job_id").distinct()


def jobs_with_initial(index: DataFrame, text: str) -> DataFrame:
    starts = _phrase_starts(index, [_phrase_terms(text)])
    return starts.where(F.col("start") == 0).select("job_id").distinct()


def jobs_with_near(index: DataFrame, *texts: str, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Jobs where all phrases occur, in any order, with at most ``distance`` tokens
    between the end of each and the start of the last one.

    For every occurrence, taken as the last one, the latest start of each phrase
    up to there decides; that is one running maximum per phrase, no pairs. Long
    logs are cut into blocks of positions, and the rows at the end of a block are
    also placed in the next one, so that no neighbourhood is cut through.
    """
    phrases = [_phrase_terms(t) for t in texts]
    span = distance + max(len(p) for p in phrases)
    block = max(_BLOCK, 4 * span)
    own = F.floor(F.col("start") / block)
    spill = F.when(F.col("start") % block >= block - span, own + 1)
    placed = (
        _phrase_starts(index, phrases)
        .select("job_id", "phrase", "start", F.explode(F.array(own, spill)).alias("block"))
        .where(F.col("block").isNotNull())
    )
    so_far = (
        Window.partitionBy("job_id", "block")
        .orderBy("start")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def close(number: int, length: int) -> Column:
        latest = F.max(F.when(F.col("phrase") == number, F.col("start"))).over(so_far)
        return F.coalesce(F.col("start") - latest - length <= distance, F.lit(False))

    tests = [close(i, len(p)) for i, p in enumerate(phrases)]
    together = reduce(lambda a, b: a & b, tests)
    return placed.select("job_id", together.alias("near")).where("near").select("job_id").distinct()


def _phrase_terms(text: str) -> list[str]:
    terms = terms_of(text)
    if not terms:
        raise ValueError("the search text holds no token")
    return terms


def _phrase_starts(index: DataFrame, phrases: Sequence[Sequence[str]], open_end: bool = False) -> DataFrame:
    """(job_id, phrase, start) of every occurrence of every phrase. With ``open_end`` the
    last token of a phrase may go on."""
    places = [
        (n, offset, F.col("term").startswith(term) if open_end and offset == len(p) - 1 else F.col("term") == term)
        for n, p in enumerate(phrases)
        for offset, term in enumerate(p)
    ]
    uses = F.array(
        *[
            F.when(fits, F.struct(F.lit(n).alias("phrase"), F.lit(offset).alias("offset")))
            for n, offset, fits in places
        ]
    )
    whole_terms = sorted({t for p in phrases for t in (p[:-1] if open_end else p)})
    beginnings = [F.col("term").startswith(p[-1]) for p in phrases] if open_end else []
    wanted = reduce(lambda a, b: a | b, beginnings, F.col("term").isin(whole_terms) if whole_terms else F.lit(False))
    rows = (
        index.where(wanted)
        .select("job_id", "pos", F.explode(uses).alias("use"))
        .where(F.col("use").isNotNull())
        .select("job_id", "use.phrase", (F.col("pos").cast("bigint") - F.col("use.offset")).alias("start"))
    )
    if all(len(p) == 1 for p in phrases):
        return rows
    whole = reduce(
        lambda a, b: a | b,
        [(F.col("phrase") == n) & (F.col("tokens") == len(p)) for n, p in enumerate(phrases)],
    )
    return (
        rows.groupBy("job_id", "phrase", "start")
        .agg(F.count("*").alias("tokens"))
        .where(whole)
        .select("job_id", "phrase", "start")
    )
