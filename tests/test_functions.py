from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from failsift.functions import fields, times


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_event_time(spark):
    texts = [
        "2025-06-17 07:08:15 UTC",
        "2025-06-17T07:08:15 UTC",
        "2025-06-17 07:08 UTC",
        "2025-06-17 07:08:15.25 UTC",
        "2025-06-17 07:08:15",
        "2025-06-17 07:08:15 UTC ",
        "2025-06-17T07:08:15Z",
        "2025-13-17 07:08:15 UTC",
        None,
    ]
    base = datetime(2025, 6, 17, 7, 8, 15)
    want = [base, base, base.replace(second=0), base.replace(microsecond=250000)] + [None] * 5
    assert values(spark, texts, times.event_time) == want


def test_event_time_does_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = values(spark, ["1970-01-01 00:00:10 UTC"], lambda t: times.event_time(t).cast("long"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [10]


def test_api_time(spark):
    texts = ["2025-02-03T04:05:06.576Z", "2025-02-03T06:05:06+02:00", "2025-02-03T06:05:06+0200", "2025-02-03T06:05:06"]
    base = datetime(2025, 2, 3, 4, 5, 6)
    assert values(spark, texts, times.api_time) == [base.replace(microsecond=576000), base, base, None]


def test_backfill_window():
    now = datetime(2024, 3, 31, 12, tzinfo=timezone.utc)
    assert times.backfill_window(now=now) == (now - timedelta(days=30), now)
    start = datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert times.backfill_window("2024-01-02", now=now) == (start, now)
    assert times.backfill_window("2024-01-02", " 2024-01-02 ", now=now) == (start, start)
    moment = times.backfill_window("2024-01-02T02:00:00+02:00", now=now, parse=times.parse_moment)
    assert moment == (start, now)
    with pytest.raises(ValueError, match="2024/01/02"):
        times.backfill_window("2024/01/02")
    with pytest.raises(ValueError):
        times.parse_moment("2024-01-02T02:00:00")


def test_small_builders(spark):
    assert values(spark, ["https://x/jobs/1"], fields.raw_log_url) == ["https://x/jobs/1/raw"]
    assert values(spark, ["https://a/b", "mailto:x@y", "http://a b", None], fields.is_uri) == [True, True, False, False]
    assert values(spark, ["a", None], lambda t: fields.breadcrumb(F.lit("1"), t, F.lit("z"))) == ["1:a:z", "1:z"]
    assert values(spark, ["4", None], lambda t: fields.or_not_available(t.cast("int"))) == ["4", "N/A"]
    url = "https://h/api/projects/3/jobs?scope%5B%5D=failed&scope%5b%5d=success&per_page=100"
    assert values(spark, ["3"], lambda t: fields.job_listing_url("https://h/api", t)) == [url]
    assert values(spark, ["3"], lambda t: fields.job_listing_url("https://h/api", t, F.lit(2))) == [url + "&page=2"]
    stamps = values(spark, ["2025-02-03T04:05:06.576Z"], lambda t: times.shown_time(times.api_time(t)))
    assert stamps == ["2025-02-03 04:05:06"]


def test_has_keys(spark):
    texts = ['{"a":null,"b":1}', '{"a":1}', "{", "[1]", None]
    assert values(spark, texts, lambda t: fields.has_keys(t, ["a", "b"])) == [True, False, False, False, False]
