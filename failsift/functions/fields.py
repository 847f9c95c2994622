"""JSON keys and paths, URLs and other small column builders."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """The value as a generated one, computed once per row.

    Spark pushes a filter below a projection by repeating the projected
    expression for every mention; it does not do so below a generator. Meant for
    costly values, such as parsed JSON, that several conditions look at.
    """
    return F.explode(F.array(value))


def has_keys(json: Column, names: Iterable[str]) -> Column:
    """The text is a JSON object holding every key, null values included."""
    absent = F.array_except(F.array(*[F.lit(n) for n in names]), F.json_object_keys(json))
    return F.coalesce(F.size(absent) == 0, F.lit(False))


def is_json_text(json: Column, *names: str) -> Column:
    """Every named field is a JSON string rather than a number, object or null."""
    parsed = F.try_parse_json(json)
    kinds = [F.schema_of_variant(F.try_variant_get(parsed, f"$.{n}", "variant")) == "STRING" for n in names]
    return F.coalesce(reduce(lambda a, b: a & b, kinds), F.lit(False))


def canonical_json(json: Column) -> Column:
    """The same JSON with sorted keys and no spacing; null if it does not parse."""
    return F.to_json(F.try_parse_json(json))


def is_uri(text: Column) -> Column:
    """The text parses as a URI."""
    return F.coalesce(
        F.try_parse_url(text, F.lit("PATH")), F.try_parse_url(text, F.lit("PROTOCOL"))
    ).isNotNull()


def raw_log_url(web_url: Column) -> Column:
    return F.concat(web_url, F.lit("/raw"))


def job_listing_url(api_root: str, project_id: Column, page: Column | None = None) -> Column:
    """Address of one page of the failed and successful jobs of a project."""
    # Fixed value: the query of the listing.
    base = F.concat(
        F.lit(f"{api_root}/projects/"),
        project_id.cast("string"),
        F.lit("/jobs?scope%5B%5D=failed&scope%5b%5d=success&per_page=100"),
    )
    return base if page is None else F.concat(base, F.lit("&page="), page.cast("string"))


def breadcrumb(*parts: Column) -> Column:
    """Trace context: the parts joined with colons, null parts left out."""
    return F.concat_ws(":", *parts)


def or_not_available(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))
