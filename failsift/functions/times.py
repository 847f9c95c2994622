"""Time parsing and formatting, all in UTC whatever the session zone is."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_EVENT_FORM = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)? UTC$"
_API_FORM = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"

DEFAULT_SPAN = timedelta(days=30)


def event_time(text: Column) -> Column:
    """``2024-02-29 23:59:01 UTC``; null for any other form."""
    stamp = F.regexp_replace(text, " UTC$", "Z")
    return F.when(text.rlike(_EVENT_FORM), _zoned(stamp))


def api_time(text: Column) -> Column:
    """ISO-8601 with a zone; null for any other form."""
    stamp = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(_API_FORM), _zoned(stamp))


def _zoned(stamp: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(stamp, r"^(.{10}.\d{2}:\d{2})(Z|[+-])", "$1:00$2"))


def shown_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parse_day(text: str) -> datetime:
    """A ``YYYY-MM-DD`` argument as midnight UTC."""
    try:
        return datetime.strptime(text.strip(), "%Y-%m-%d").replace(tzinfo=timezone.utc)
    except ValueError:
        raise ValueError(f"not a day of the form YYYY-MM-DD: {text}") from None


def parse_moment(text: str) -> datetime:
    """An ISO-8601 argument with a zone."""
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        moment = None
    if moment is None or moment.tzinfo is None:
        raise ValueError(f"not a moment with a zone: {text}")
    return moment.astimezone(timezone.utc)


def backfill_window(
    start: str | None = None,
    end: str | None = None,
    now: datetime | None = None,
    parse=parse_day,
) -> tuple[datetime, datetime]:
    """The date range of a backfill: by default the thirty days before now."""
    now = now or datetime.now(timezone.utc)
    first = parse(start) if start is not None else now - DEFAULT_SPAN
    last = parse(end) if end is not None else now
    return first, last
