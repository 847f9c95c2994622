"""Search of the archive: keyword, condition or tree to a page of jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failsift.operators import search
from failsift.operators.tree import Phrase, Tree, exact_terms, jobs_in_index, jobs_in_logs
from failsift.sources.store import read_index, read_table

# Pages up to this number are fetched with all rows before them.
NEAR_PAGES = 20


def found_ids(
    wanted: str | Column | Tree | None, logs: DataFrame | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Ids of the logs that match: by the index if there is one, else by a scan of the logs.

    A text is taken as one phrase; one without a letter or digit is a phrase that no log
    holds. Conditions built with the search operators need the logs.
    """
    if isinstance(wanted, Column):
        return search.matches(logs, wanted)
    tree = Phrase("") if not wanted or not search.is_search(wanted) else Phrase(wanted) if isinstance(wanted, str) else wanted
    return jobs_in_logs(tree, logs) if index is None else jobs_in_index(tree, index)


def find(
    jobs: DataFrame,
    logs: DataFrame | None,
    wanted: str | Column | Tree | None,
    page: int = 1,
    size: int = search.PAGE_SIZE,
    index: DataFrame | None = None,
    after: tuple[datetime, int] | None = None,
) -> DataFrame:
    """One page of the jobs whose log matches: by its number, or ``after`` the (created_at,
    job_id) of the last row shown.

    Without a keyword there is no search, and the page is empty; ask
    :func:`failsift.operators.search.is_search` to tell that from no results.
    """
    found = search.found_jobs(jobs, found_ids(wanted, logs, index))
    if after:
        shown = search.page_after(found, after, size)
    elif page > NEAR_PAGES:
        shown = search.page_by_ranges(found, page, size)
    else:
        shown = search.result_page(found, page, size)
    return search.page_fields(jobs, shown)


def find_stored(spark: SparkSession, root: str, tree: Tree, page: int = 1, size: int = search.PAGE_SIZE) -> DataFrame:
    """A page from the store: its index, cut to the terms of the tree, and its jobs."""
    terms = exact_terms(tree)
    index = read_index(spark, root, *sorted(terms or ()))
    return find(read_table(spark, root, "job"), None, tree, page, size, index)


def total(logs: DataFrame | None, wanted: str | Column | Tree, index: DataFrame | None = None) -> DataFrame:
    """The number of matching logs."""
    return found_ids(wanted, logs, index).agg(F.count("*").alias("matches"))
