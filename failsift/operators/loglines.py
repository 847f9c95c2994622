"""Line-level log analytics: grep, failing test names, kinds of stat tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failsift.operators.sizing import JobIds
from failsift.session import settle


def grep(logs: DataFrame, pattern: str) -> DataFrame:
    """(job_id, line_no, line) of the matching lines, prefixed with the job id.

    A log without a match yields one row with an empty line and number 0. The
    lines are picked inside the row of their log, so nothing is shuffled and the
    misses need no second look at the logs.
    """
    body = F.regexp_replace("trace", r"\n\z", "")
    numbered = F.transform(
        F.split(body, "\n"),
        lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line")),
    )
    found = F.when(
        F.length("trace") > 0,
        F.filter(numbered, lambda l: l["line"].rlike("(?d)" + pattern)),
    )
    miss = F.array(F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("").alias("line")))
    return (
        logs.select("job_id", found.alias("found"))
        .select("job_id", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(miss)).alias("l"))
        .select(
            "job_id",
            F.col("l.line_no").alias("line_no"),
            F.concat(F.col("job_id").cast("string"), F.lit(":"), F.col("l.line")).alias("line"),
        )
    )


def grep_ranges(parts: DataFrame, pattern: str) -> DataFrame:
    """The same as :func:`grep` over logs that come in ranges (job_id, start, trace) cut at line ends.

    Each range numbers its own lines and counts its line ends. Numbers within the log follow
    from sums over its ranges, which meet as found lines and counts, without log text. A log
    with a range that is not valid text (``trace`` null) is left out. Of a line that had to be
    cut each part is searched, under one number.
    """
    lines = F.split(F.regexp_replace("trace", r"\n\z", ""), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line")))
    some = F.length("trace") > 0
    found = F.when(some, F.filter(numbered, lambda l: l["line"].rlike("(?d)" + pattern)))
    held = F.length("trace") - F.length(F.replace("trace", F.lit("\n"), F.lit("")))
    # one entry without a line stands for the range itself
    range_ = F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("line"))
    rows = parts.select(
        "job_id", "start", held.alias("held"), F.explode(F.concat(F.array(range_), F.coalesce(found, F.array()))).alias("l")
    )
    of_job = Window.partitionBy("job_id")
    earlier = of_job.orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    counted = rows.select(
        "job_id",
        "start",
        "l.line",
        (F.col("l.line_no") + F.coalesce(F.sum(F.when(F.col("l.line").isNull(), F.col("held"))).over(earlier), F.lit(0))).alias("line_no"),
        F.count("l.line").over(of_job).alias("matches"),
        F.count_if(F.col("held").isNull()).over(of_job).alias("unread"),
    ).where("unread = 0")
    shown = F.col("line").isNotNull() | ((F.col("matches") == 0) & (F.col("start") == 0))
    return counted.where(shown).select(
        "job_id",
        F.when(F.col("line").isNull(), 0).otherwise(F.col("line_no")).cast("bigint").alias("line_no"),
        F.concat(F.col("job_id").cast("string"), F.lit(":"), F.coalesce("line", F.lit(""))).alias("line"),
    )


def grep_jobs(logs: DataFrame, ids: DataFrame, pattern: str) -> DataFrame:
    """Grep over the logs of the selected jobs, in reverse lexical order of the ids.

    A short selection picks the logs before they are searched. A long one is
    joined with the lines found, so that no join ever moves a whole log. The
    lines are stored before they are sorted, as the sort takes a sample first.
    """
    wanted = JobIds(ids)
    chosen = wanted.pick(logs)
    lines = settle(wanted.semi_join(grep(logs, pattern)) if chosen is None else grep(chosen, pattern))
    return lines.orderBy(F.col("job_id").cast("string").desc(), "line_no")


# Fixed value: how the test driver names the failing tests, one line per run.
TEST_LINE = r'(?md)^TEST="([^"\n]*)"'


def failing_tests(logs: DataFrame) -> DataFrame:
    """Distinct test names of all ``TEST="..."`` lines."""
    names = F.flatten(
        F.transform(F.regexp_extract_all("trace", F.lit(TEST_LINE), F.lit(1)), lambda s: F.split(s, " "))
    )
    return (
        logs.select(F.explode(F.array_distinct(names)).alias("test_name"))
        .where(F.col("test_name") != "")
        .distinct()
    )


def stat_test_kinds(tests: DataFrame, definitions: DataFrame) -> DataFrame:
    """Number of definition lines of the failing tests that collect stats of each kind.

    Definition lines are counted per name before the join, so a name with very
    many lines is one row there.
    """
    per_name = definitions.groupBy("test_name").agg(
        F.count_if(F.col("kind").contains("collect_stats")).alias("stats"),
        F.count_if(F.col("kind").contains("collect_compiler")).alias("compiler"),
    )
    totals = per_name.join(tests.select("test_name"), "test_name", "left_semi").agg(
        F.coalesce(F.sum("stats"), F.lit(0)).alias("stats"),
        F.coalesce(F.sum("compiler"), F.lit(0)).alias("compiler"),
    )
    return _by_kind(totals)


CONTEXT_LINES = 3


def stat_tests_from_source(lines: DataFrame, tests: DataFrame) -> DataFrame:
    """Kinds of stat tests, counted in source lines (file, line_no, text).

    A line that speaks of collecting counts for a test if the name of the test stands as
    a word in it or in one of the three lines before it; once per test and line.
    """
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    named = (
        lines.select("file", "line_no", F.explode(words).alias("test_name"))
        .join(tests.select("test_name").distinct(), "test_name", "left_semi")
        .select(
            "file",
            "test_name",
            F.explode(F.transform(F.sequence(F.lit(0), F.lit(CONTEXT_LINES)), lambda i: F.col("line_no") + i)).alias("line_no"),
        )
        .distinct()
    )
    return _collecting_near(named, lines)


GRAM = 6
MAX_SENT_NAMES = 200


def _grams(text: Column, length: int) -> Column:
    """The distinct runs of ``length`` characters of a text, in one walk over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def names_within(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(file, line_no, test_name) where a name stands anywhere in a line, also within words.

    A few names are sought in each line where it lies. Of more, every name is looked up by that run of six characters (or the whole name, if shorter) of
    its own which the fewest lines hold, so a line meets a name only if they share it; what
    meets is verified. Only runs that names have are counted and joined.
    """
    wanted = settle(names.where(F.length("test_name") > 0).select("test_name").distinct())
    few = [r.test_name for r in wanted.limit(MAX_SENT_NAMES + 1).collect()]
    if len(few) <= MAX_SENT_NAMES:
        here = F.filter(F.array(*map(F.lit, few)), lambda name: F.col("text").contains(name)) if few else F.array().cast("array<string>")
        return lines.select("file", "line_no", F.explode(here).alias("test_name"))
    sizes = [r[0] for r in wanted.select(F.least(F.length("test_name"), F.lit(GRAM))).distinct().collect()]
    own = wanted.select("test_name", F.explode(F.when(F.length("test_name") < GRAM, F.array("test_name")).otherwise(_grams(F.col("test_name"), GRAM))).alias("gram"))
    of_line = F.flatten(F.array(*[_grams(F.col("text"), n) for n in sorted(sizes)])) if sizes else F.array().cast("array<string>")
    held = lines.select("file", "line_no", F.explode(of_line).alias("gram"))
    counts = held.select("gram").join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        own.join(counts, "gram", "left")
        .groupBy("test_name")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .where("least.n > 0")
        .select("test_name", F.col("least.gram").alias("gram"))
    )
    met = held.join(settle(rarest), "gram").select("file", "line_no", "test_name")
    verified = met.join(lines.select("file", "line_no", "text"), ["file", "line_no"]).where(F.col("text").contains(F.col("test_name")))
    return verified.select("file", "line_no", "test_name")


def stat_tests_substring(lines: DataFrame, tests: DataFrame) -> DataFrame:
    """The same as :func:`stat_tests_from_source` for names of any characters, found anywhere in a line."""
    named = (
        names_within(lines, tests)
        .select("file", "test_name", F.explode(F.transform(F.sequence(F.lit(0), F.lit(CONTEXT_LINES)), lambda i: F.col("line_no") + i)).alias("line_no"))
        .distinct()
    )
    return _collecting_near(named, lines)


def _collecting_near(named: DataFrame, lines: DataFrame) -> DataFrame:
    """Kinds of the collecting lines that stand near a name."""
    collecting = lines.where(F.col("text").contains("collect_")).select(
        "file",
        "line_no",
        F.col("text").contains("collect_stats").cast("long").alias("stats"),
        F.col("text").contains("collect_compiler").cast("long").alias("compiler"),
    )
    totals = named.join(collecting, ["file", "line_no"]).agg(
        F.coalesce(F.sum("stats"), F.lit(0)).alias("stats"), F.coalesce(F.sum("compiler"), F.lit(0)).alias("compiler")
    )
    return _by_kind(totals)


def _by_kind(totals: DataFrame) -> DataFrame:
    return totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("collect_stats").alias("kind"), F.col("stats").alias("lines")),
                F.struct(F.lit("collect_compiler").alias("kind"), F.col("compiler").alias("lines")),
            )
        )
    )


def windows_failures(builds: DataFrame, since: str, project_id: int = 1) -> DataFrame:
    """Failed Windows builds started after ``since``, the latest first."""
    return (
        builds.where(
            F.col("name").like("%windows%")
            & (F.col("project_id") == project_id)
            & F.col("started_at").isNotNull()
            & (F.col("status") == "failed")
            & (F.col("started_at") > F.to_timestamp(F.lit(since)))
        )
        .select("id", "started_at")
        .orderBy(F.col("started_at").desc(), F.col("id").desc())
    )
