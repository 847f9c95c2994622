"""The registered queries, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from failsift.catalog import Check, active_checks
from failsift.functions.fields import canonical_json
from failsift.functions.text import normalise
from failsift.functions.times import api_time, backfill_window
from failsift.operators import backfill, decode, enrich, grepindex, hooks, index, loglines, retry, search, tree, upsert
from failsift.operators.classify import classify, label_gaps, retry_candidates, unclassified
from failsift.plans import archive, lookup
from failsift.plans.triage import Triage, triage
from failsift.session import settle, work_dir
from failsift.sources import store
from failsift.sources.files import job_listing, log_urls
from failsift.sources.rawlogs import chosen_logs, raw_logs, write_logs
from failsift.streaming.budget import retry_budget_stream
from failsift.streaming.triage import triage_stream, unique_events, waiting_events
from workload.views import stream_view, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOOK_URL = "http://127.0.0.1:8080/hook"
RANGE = backfill_window("2024-01-02", "2024-01-03")
NESTED = tree.But(
    tree.Either((tree.Phrase("failed to connect"), tree.Prefix("cannot modi"), tree.Initial("el"))),
    tree.All((tree.Phrase("failed"), tree.Prefix("gitl"))),
)


def query(fn: Query) -> Query:
    """Register a query under its name, less a closing underscore."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


# Classification


@query
def classify_literal(spark, sf):
    return classify(view(spark, sf, "job_log"), active_checks("literal"))


@query
def classify_regex(spark, sf):
    return classify(view(spark, sf, "job_log"), active_checks("pattern"))


@query
def classify_reason(spark, sf):
    return classify(view(spark, sf, "job_log"), active_checks("reason"))


@query
def classify_all(spark, sf):
    return classify(view(spark, sf, "job_log"))


@query
def unclassified_(spark, sf):
    return unclassified(view(spark, sf, "job_log"))


@query
def enum_gap(spark, sf):
    return label_gaps(classify(view(spark, sf, "job_log")))


@query
def own_check(spark, sf):
    """Entries of a user's own next to those of the catalog."""
    own = [
        Check("long_log", "more than 3000 characters", lambda reason, log: F.length(log) > 3000, "pattern"),
        Check("stuck_or_11", "stuck, or error -11", lambda reason, log: (reason == "stuck_or_timeout_failure") | log.contains("-11"), "pattern"),
    ]
    return classify(view(spark, sf, "job_log"), own)


# Decoding


def _events(spark, sf):
    return decode.job_events(view(spark, sf, "job_event").select("payload"))


def _jobs(spark, sf):
    return decode.job_records(view(spark, sf, "job").select("job_blob"))


def _projects(spark, sf):
    return decode.projects(view(spark, sf, "project"))


@query
def event_decode(spark, sf):
    return _events(spark, sf)


@query
def event_quarantine(spark, sf):
    return decode.rejected_events(view(spark, sf, "job_event").select("event_id", "payload"))


@query
def finished_events(spark, sf):
    return decode.finished(_events(spark, sf))


@query
def status_dispatch(spark, sf):
    return decode.dispatch(_events(spark, sf)).drop("build_finished_at")


@query
def system_event_kind(spark, sf):
    return decode.system_events(view(spark, sf, "system_event"))


@query
def reason_normalise(spark, sf):
    reason = F.col("failure_reason")
    kind = decode.reason_kind(reason)
    return view(spark, sf, "job_log").select(
        "job_id", kind.alias("kind"), decode.reason_text(kind, reason).alias("reason")
    )


@query
def job_decode(spark, sf):
    return _jobs(spark, sf).drop("job_blob")


@query
def job_quarantine(spark, sf):
    return decode.rejected_jobs(view(spark, sf, "job").select("job_id", "job_blob")).select("job_id")


@query
def project_quarantine(spark, sf):
    return decode.rejected_projects(view(spark, sf, "project_delivery"))


@query
def retry_response_quarantine(spark, sf):
    return decode.rejected_responses(view(spark, sf, "retry_response")).select("job_id")


@query
def json_extract(spark, sf):
    path = lambda p: F.get_json_object("job_blob", p)
    return view(spark, sf, "job").select(
        "job_id",
        path("$.created_at").alias("created_at"),
        path("$.name").alias("name"),
        path("$.runner.id").cast("bigint").alias("runner_id"),
        path("$.runner.description").alias("runner_name"),
    )


@query
def json_canonical(spark, sf):
    return view(spark, sf, "job").select("job_id", canonical_json(F.col("job_blob")).alias("job_blob"))


# Enrichment, failure rows, sinks


def _finished_jobs(spark, sf):
    return enrich.finished_jobs(decode.finished(_events(spark, sf)), _jobs(spark, sf), _projects(spark, sf))


def _triage(spark, sf) -> Triage:
    logs = view(spark, sf, "job_log").select("job_id", "trace")
    return triage(_events(spark, sf), _jobs(spark, sf), _projects(spark, sf), logs)


@query
def job_enrich(spark, sf):
    return _finished_jobs(spark, sf)


@query
def finish_quarantine(spark, sf):
    return enrich.without_finish_time(decode.finished(_events(spark, sf)), _jobs(spark, sf))


@query
def failure_rows(spark, sf):
    return _triage(spark, sf).failures


@query
def retry_commands(spark, sf):
    return _triage(spark, sf).commands


@query
def retry_candidates_(spark, sf):
    failed = _finished_jobs(spark, sf).where(F.col("build_status") == "failed")
    return retry_candidates(failed.select("job_id", "project_id"), classify(view(spark, sf, "job_log")))


@query
def failure_upsert(spark, sf):
    hits = settle(classify(view(spark, sf, "job_log")).select("job_id", "type"))
    stored = hits.where(F.col("job_id") % 2 == 0)
    return upsert.new_rows(hits.unionByName(hits), stored, ["job_id", "type"])


@query
def job_upsert(spark, sf):
    rows = settle(enrich.index_rows(_jobs(spark, sf)))
    stored = rows.where(F.col("job_id") % 3 == 0)
    return upsert.new_rows(rows.unionByName(rows), stored, ["job_id"])


@query
def failure_import(spark, sf):
    hits = classify(view(spark, sf, "job_log")).select("job_id", F.col("type").alias("typ"))
    jobs = _jobs(spark, sf).select("job_id", "created_at", "web_url", "runner_id")
    return enrich.imported_failures(hits.join(jobs, "job_id"))


def _stored_logs(spark, sf):
    return view(spark, sf, "job_log").where(F.col("job_id") % 4 != 0)


@query
def log_backlog(spark, sf):
    jobs = enrich.index_rows(_jobs(spark, sf))
    return log_urls(upsert.missing(jobs, _stored_logs(spark, sf)))


@query
def log_backlog_size(spark, sf):
    return log_backlog(spark, sf).agg(F.count("*").alias("jobs"))


@query
def backfill_range(spark, sf):
    jobs = view(spark, sf, "job").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return backfill.in_range(jobs, *RANGE).select("job_id", "created_at", "status")


@query
def backfill_default_range(spark, sf):
    jobs = view(spark, sf, "job").withColumn("created_at", F.col("created_at").cast("timestamp"))
    start, end = backfill_window(now=datetime(2024, 2, 1, 12, tzinfo=timezone.utc))
    return backfill.in_range(jobs, start, end).select("job_id", "created_at", "status")


@query
def page_age_class(spark, sf):
    jobs = view(spark, sf, "job").select(
        F.floor(F.col("job_id") / 100).alias("page"), F.col("created_at").cast("timestamp").alias("created_at")
    )
    return backfill.page_age(jobs, *RANGE)


def _archive(spark, sf) -> str:
    """Staging, backlog and log store in one run; the folder of the store."""
    root = work_dir(spark, "archive")
    store.init_store(spark, root)
    listing = view(spark, sf, "job").withColumn("created_at", F.col("created_at").cast("timestamp"))
    archive.stage_jobs(listing, root, *RANGE, batch="staged")
    archive.drain_backlog(view(spark, sf, "job_log").select("job_id", "trace"), root, batch="drained")
    return root


@query
def archive_backfill(spark, sf):
    terms = store.read_index(spark, _archive(spark, sf))
    return terms.groupBy("job_id").agg(F.count("*").alias("tokens"))


@query
def archive_search(spark, sf):
    """A look-up in the stored index, with the page of stored jobs it leads to."""
    root = _archive(spark, sf)
    found = index.jobs_with_any(store.read_index(spark, root, "failed", "error"), "failed", "error")
    jobs = store.read_table(spark, root, "job")
    return search.page_fields(jobs, search.result_page(search.found_jobs(jobs, found)))


def _listing(spark, sf) -> DataFrame:
    return view(spark, sf, "job").select("job_id", "job_blob")


@query
def listing_pages(spark, sf):
    """Pages of listed jobs, each a file of its own, read as one table."""
    folder = work_dir(spark, "listing")
    pages = _listing(spark, sf).select("job_blob", F.floor(F.col("job_id") / 100).alias("page"))
    pages.repartition("page").write.partitionBy("page").text(folder)
    return job_listing(spark, folder).select("job_id", "status", "created_at", "web_url")


def _job_parts(spark, sf, parts: int = 4) -> str:
    """The job table filled in parts that each hold all jobs of the parts before; the folder of the store."""
    _, root = _fresh_store(spark, "parts")
    rows = settle(enrich.index_rows(_jobs(spark, sf)))
    for part in range(parts):
        store.append_new(rows.where(F.col("job_id") % parts <= part), root, "job", f"part-{part}")
    return root


@query
def rows_added(spark, sf):
    """What each append added, as counted on the way to the store."""
    return store.contents(spark, _job_parts(spark, sf)).where("rows > 0")


@query
def merged_jobs(spark, sf):
    """The job table after its folders were merged, and a batch that ran again after that."""
    root = _job_parts(spark, sf)
    store.tidy(spark, root, "job")
    again = enrich.index_rows(_jobs(spark, sf)).where(F.col("job_id") % 4 <= 2)
    store.append_new(again, root, "job", "part-2")
    return store.read_table(spark, root, "job").select("job_id", "job_url", "created_at")


@query
def store_contents(spark, sf):
    """Rows per table of a store that was created empty and filled by the backfill."""
    held = store.contents(spark, _archive(spark, sf))
    return held.groupBy("table_name").agg(F.sum("rows").alias("rows"))


# Search


def _logs(spark, sf):
    return view(spark, sf, "job_log").select("job_id", "trace")


def _terms(spark, sf):
    return index.term_rows(_logs(spark, sf))


@query
def tokenise(spark, sf):
    return view(spark, sf, "job_log").select("job_id", normalise(F.col("trace")).alias("norm"))


@query
def term_index(spark, sf):
    return _terms(spark, sf)


@query
def search_phrase(spark, sf):
    return search.matches(_logs(spark, sf), search.phrase("failed to connect to GitLab"))


@query
def search_concat(spark, sf):
    return search.matches(_logs(spark, sf), search.phrase("cannot connect", "to the Docker"))


@query
def search_all(spark, sf):
    both = search.all_of(search.phrase("Failed"), search.phrase("hard_3"))
    return search.matches(_logs(spark, sf), both)


@query
def search_any(spark, sf):
    either = search.any_of(search.phrase("MoveFileEx"), search.phrase("sigquit: quit"))
    return search.matches(_logs(spark, sf), either)


@query
def search_not(spark, sf):
    rest = search.but_not(search.phrase("error code"), search.phrase("11"))
    return search.matches(_logs(spark, sf), rest)


@query
def search_prefix(spark, sf):
    return search.matches(_logs(spark, sf), search.prefix("cannot modi"))


@query
def search_initial(spark, sf):
    return search.matches(_logs(spark, sf), search.initial("El"))


@query
def search_near(spark, sf):
    return index.jobs_with_near(_terms(spark, sf), "que", "la", "de", distance=4)


@query
def search_near_default(spark, sf):
    return index.jobs_with_near(_terms(spark, sf), "hard", "failed")


@query
def search_near_phrases(spark, sf):
    return index.jobs_with_near(_terms(spark, sf), "spawnp resource", "hard", distance=3)


def _indexed(spark, sf) -> str:
    """A store with all jobs and the index of all logs; its folder."""
    root = work_dir(spark, "indexed")
    store.init_store(spark, root)
    logs = view(spark, sf, "job_log").select("job_id", "trace")
    store.append_logs(logs.select("job_id"), logs, root, "all")
    jobs = view(spark, sf, "job").select(
        "job_id",
        F.col("web_url").alias("job_url"),
        api_time(F.get_json_object("job_blob", "$.created_at")).alias("created_at"),
        "job_blob",
    )
    store.append_new(jobs, root, "job", "all")
    return root


@query
def search_index_page(spark, sf):
    return lookup.find_stored(spark, _indexed(spark, sf), tree.Phrase("failed"), page=2)


@query
def search_nested(spark, sf):
    root = _indexed(spark, sf)
    return lookup.found_ids(NESTED, index=store.read_index(spark, root))


@query
def compacted_search(spark, sf):
    """The nested search over an index that came in eight batches and was merged in between."""
    root = work_dir(spark, "compacted")
    store.init_store(spark, root)
    logs = view(spark, sf, "job_log").select("job_id", "trace")
    for part in range(8):
        some = logs.where(F.col("job_id") % 8 == part)
        store.append_logs(some.select("job_id"), some, root, f"part-{part}")
        store.tidy(spark, root, "log_term")
    return lookup.found_ids(NESTED, index=store.read_index(spark, root))


@query
def search_near_page(spark, sf):
    root = _indexed(spark, sf)
    wanted = tree.But(tree.Near(("que", "la", "de"), 4), tree.Phrase("hard 3"))
    return lookup.find_stored(spark, root, wanted)


@query
def search_empty_keyword(spark, sf):
    """A keyword without a token matches no log."""
    return lookup.total(view(spark, sf, "job_log").select("job_id", "trace"), "-- !")


@query
def index_phrase(spark, sf):
    return index.jobs_with_phrase(_terms(spark, sf), "command failed with error code")


@query
def index_all(spark, sf):
    return index.jobs_with_all(_terms(spark, sf), "failed", "connect", "t1")


@query
def index_any(spark, sf):
    return index.jobs_with_any(_terms(spark, sf), "movefileex", "sigquit")


@query
def index_not(spark, sf):
    return index.jobs_with_but_not(_terms(spark, sf), "error", "11")


@query
def index_prefix(spark, sf):
    return index.jobs_with_prefix(_terms(spark, sf), "movefile")


@query
def index_initial(spark, sf):
    return index.jobs_with_initial(_terms(spark, sf), "El")


def _job_rows(spark, sf):
    return view(spark, sf, "job").select("job_id", F.col("web_url").alias("job_url"), "job_blob")


@query
def search_page(spark, sf):
    return lookup.find(_job_rows(spark, sf), _logs(spark, sf), search.phrase("failed"), page=2)


@query
def search_page_after(spark, sf):
    """The page behind the last row of the first one."""
    jobs, logs, wanted = _job_rows(spark, sf), _logs(spark, sf), search.phrase("failed")
    first = lookup.find(jobs, logs, wanted).agg(F.min(F.struct("created_at", "job_id")).alias("last")).first()
    return lookup.find(jobs, logs, wanted, after=tuple(first["last"]))


@query
def search_page_far(spark, sf):
    """A page by its number, from the ranges of the result that hold it."""
    found = search.found_jobs(_job_rows(spark, sf), search.matches(_logs(spark, sf), search.phrase("failed")))
    return search.page_by_ranges(found, page=5, size=10)


@query
def search_last_page(spark, sf):
    return search.shown(lookup.find(_job_rows(spark, sf), _logs(spark, sf), "resource busy"))


@query
def search_count(spark, sf):
    return lookup.total(_logs(spark, sf), search.phrase("failed"))


# Log lines


@query
def grep_logs(spark, sf):
    logs = view(spark, sf, "job_log").select("job_id", "trace")
    ids = view(spark, sf, "job").where(F.col("status") == "failed").select("job_id")
    return loglines.grep_jobs(logs, ids, "[Ff]ailed|error")


@query
def grep_indexed(spark, sf):
    """All logs, through stored signatures of their blocks."""
    folder = work_dir(spark, "grep-index")
    grepindex.write_grep_index(view(spark, sf, "job_log").select("job_id", "trace"), folder)
    return grepindex.grep_indexed(spark, folder, "[Ff]ailed|error")


def _log_files(spark, sf) -> str:
    """The logs as files, some of them no valid UTF-8; their folder."""
    folder = work_dir(spark, "raw-logs")
    trace = F.col("trace").cast("binary")
    content = F.when(F.col("job_id") % 19 == 0, F.concat(trace, F.unhex(F.lit("FF")))).otherwise(trace)
    write_logs(view(spark, sf, "job_log").select("job_id", content.alias("content")), folder)
    return folder


@query
def raw_log_source(spark, sf):
    """The logs of the failed jobs from their files; other files are not opened."""
    ids = view(spark, sf, "job").where(F.col("status") == "failed").select("job_id")
    logs = chosen_logs(spark, _log_files(spark, sf), ids)
    return logs.select("job_id", "size", F.md5("trace").alias("digest"))


@query
def raw_log_grep(spark, sf):
    """Lines of all log files, long ones cut into ranges."""
    logs = raw_logs(spark, _log_files(spark, sf), partition_bytes=16_384)
    return loglines.grep_ranges(logs.where("job_id IS NOT NULL"), "[Ff]ailed|error")


@query
def failing_tests(spark, sf):
    return loglines.failing_tests(view(spark, sf, "job_log")).orderBy("test_name")


@query
def stat_test_kinds(spark, sf):
    tests = loglines.failing_tests(view(spark, sf, "job_log"))
    return loglines.stat_test_kinds(tests, view(spark, sf, "test_def"))


def _source_lines(spark, sf) -> DataFrame:
    files = view(spark, sf, "source_file").select("file", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    number = F.col("place") + 1
    mark = (
        F.when((F.col("file") + number) % 5 == 0, " collect_stats").when((F.col("file") + number) % 7 == 0, " collect_compiler_x").otherwise("")
    )
    return files.select("file", number.alias("line_no"), F.concat("line", mark).alias("text"))


@query
def stat_tests_from_source(spark, sf):
    tests = spark.createDataFrame([("the",), ("que",), ("der",), ("thnt",)], "test_name STRING")
    return loglines.stat_tests_from_source(_source_lines(spark, sf), tests)


@query
def stat_tests_substring(spark, sf):
    """The failing tests, found anywhere in the lines of all logs."""
    lines = view(spark, sf, "job_log").select(F.col("job_id").alias("file"), F.posexplode(F.split("trace", "\n")).alias("place", "line"))
    number = F.col("place") + 1
    mark = F.when((F.col("file") + number) % 5 == 0, " collect_stats").otherwise("")
    marked = lines.select("file", number.alias("line_no"), F.concat("line", mark).alias("text"))
    return loglines.stat_tests_substring(marked, loglines.failing_tests(view(spark, sf, "job_log")))


def _builds(spark, sf):
    return view(spark, sf, "ci_build").withColumn("started_at", F.col("started_at").cast("timestamp"))


@query
def windows_failed_jobs(spark, sf):
    return loglines.windows_failures(_builds(spark, sf), "2024-01-02")


@query
def windows_logs_to_fetch(spark, sf):
    failed = loglines.windows_failures(_builds(spark, sf), "2024-01-02").withColumnRenamed("id", "job_id")
    return upsert.missing(failed, _stored_logs(spark, sf))


# Hooks


def _audit(spark, sf):
    return view(spark, sf, "audit_project"), view(spark, sf, "hook")


@query
def hook_missing(spark, sf):
    return hooks.newest_first(hooks.without_hook(*_audit(spark, sf)))


@query
def hook_present(spark, sf):
    return hooks.newest_first(hooks.with_hook(*_audit(spark, sf)))


@query
def hook_plan(spark, sf):
    return hooks.hooks_for_new_projects(decode.system_events(view(spark, sf, "system_event")), HOOK_URL)


@query
def hook_plan_audit(spark, sf):
    return hooks.hooks_from_audit(*_audit(spark, sf), HOOK_URL)


# Retries


@query
def retry_budget(spark, sf):
    return retry.retry_budget(view(spark, sf, "retry_cmd"))


@query
def retry_lineage(spark, sf):
    return retry.retry_lineage(decode.retry_links(view(spark, sf, "retry_response")))


@query
def retry_lineage_conversations(spark, sf):
    return retry.retry_lineage(view(spark, sf, "conversation_link"))


@query
def retry_bookkeeping(spark, sf):
    links = decode.retry_links(view(spark, sf, "retry_response"))
    return retry.bookkeeping(view(spark, sf, "job_cmd"), links)


# Streams


def _arrive(rows: DataFrame, folder: str, start: Callable[[DataFrame], DataStreamWriter], parts: int = 4) -> None:
    """Let rows arrive in parts by their ``number``, which is dropped; the stream is started anew for each."""
    spark = rows.sparkSession
    for part in range(parts):
        rows.where(F.col("number") % parts == part).drop("number").write.parquet(f"{folder}/arrival={part}")
        stream = spark.readStream.schema(rows.drop("number").schema).parquet(f"{folder}/arrival=*")
        start(stream).trigger(availableNow=True).start().awaitTermination()


def _arriving_events(spark, sf) -> DataFrame:
    return view(spark, sf, "job_event").select("payload", F.col("event_id").alias("number"))


def _fresh_store(spark, purpose: str) -> tuple[str, str]:
    folder = work_dir(spark, purpose)
    store.init_store(spark, f"{folder}/store")
    return folder, f"{folder}/store"


@query
def stream_dedupe(spark, sf):
    """Every fifth event comes again in each part, so most copies are far behind the newest."""
    folder, root = _fresh_store(spark, "dedupe")
    events = _arriving_events(spark, sf)
    again = F.explode(F.when(F.col("number") % 5 == 0, F.sequence(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0))))
    delivered = events.withColumn("copy", again).select("payload", (F.col("number") + F.col("copy")).alias("number"))
    _arrive(
        delivered,
        f"{folder}/events",
        lambda stream: unique_events(decode.job_events(stream), root, f"{folder}/progress"),
    )
    return store.read_table(spark, root, "event").drop("batch")


@query
def stream_retry(spark, sf):
    folder, root = _fresh_store(spark, "retry")
    commands = view(spark, sf, "retry_cmd").withColumn("number", F.col("seq"))
    _arrive(commands, f"{folder}/commands", lambda stream: retry_budget_stream(stream, root, f"{folder}/progress"))
    return store.read_table(spark, root, "retry_decision").drop("batch")


@query
def stream_retry_batches(spark, sf):
    folder, root = _fresh_store(spark, "retry")
    commands = stream_view(spark, sf, "events", "retry_cmd")
    writer = retry_budget_stream(commands, root, f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return store.read_table(spark, root, "retry_decision").drop("batch")


def _triage_in_parts(spark, sf, landed=lambda logs, part: logs, links=None) -> str:
    """The triage stream over events in four parts; ``landed`` cuts the logs that are there at a part."""
    folder, root = _fresh_store(spark, "triage")
    logs, part = view(spark, sf, "job_log").select("job_id", "trace"), iter(range(99))
    _arrive(
        _arriving_events(spark, sf),
        f"{folder}/events",
        lambda stream: triage_stream(
            decode.job_events(stream),
            jobs=lambda: view(spark, sf, "job").select("job_id", "job_blob"),
            projects=lambda: _projects(spark, sf),
            logs=lambda: landed(logs, next(part)),
            root=root,
            checkpoint=f"{folder}/progress",
            links=links,
        ),
    )
    return root


@query
def stream_triage(spark, sf):
    """Logs come up to three parts after their event."""
    root = _triage_in_parts(spark, sf, lambda logs, part: logs.where(F.col("job_id") % 16 <= 5 * part + 1))
    return store.read_table(spark, root, "ci_failure").drop("batch")


@query
def stream_pending(spark, sf):
    """Events that still wait when the logs of every seventh job never come."""
    root = _triage_in_parts(spark, sf, lambda logs, part: logs.where(F.col("job_id") % 7 != 0))
    return waiting_events(spark, root, "triage", 99)


@query
def stream_triage_decisions(spark, sf):
    links = decode.retry_links(view(spark, sf, "retry_response"))
    root = _triage_in_parts(spark, sf, links=lambda: links)
    return store.read_table(spark, root, "retry_decision").drop("batch")
