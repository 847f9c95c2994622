"""The registered queries as SQL for the checking engine."""

from __future__ import annotations

from workload.views import with_views

# Fixed values: (code, message, condition over reason and trace), written out apart from the catalog.
_LITERAL = [
    ("docker", "docker failure", "contains(trace, 'Cannot connect to the Docker daemon at unix:///var/run/docker.sock')"),
    ("connect_gitlab", "GitLab connection failure", "contains(trace, 'Failed to connect to gitlab.haskell.org')"),
    ("MoveFileEx", "MoveFileEx-related failure", "contains(trace, 'MoveFileEx')"),
    ("ghc-pkg_died", "ghc-pkg or hadrian failure", "contains(trace, 'ghc-pkg dump failed: dieVerbatim: user error')"),
    (
        "nix_T7273",
        "Nix#7273 failure",
        "contains(trace, 'cannot link ''/nix/store/.tmp-link') OR contains(trace, 'error: clearing flags of path ''/nix/store')",
    ),
    (
        "runner_process_terminated",
        "runner terminated",
        "contains(trace, 'ERROR: Job failed (system failure): aborted: terminated')",
    ),
    (
        "repo_clone",
        "error cloning fresh repository",
        "contains(trace, 'fresh repository.' || chr(27) || '[0;m' || chr(10) || 'error')",
    ),
    (
        "perf_note_fetch",
        "error fetch perf notes",
        "contains(trace, 'refs/notes/perf:refs/notes/perf' || chr(10) || 'error:')",
    ),
    ("stack_T6388", "stack #6388", "contains(trace, 'Error: [S-922]')"),
    (
        "hadrian_locked_file",
        "Hadrian exception: locked file",
        "contains(trace, 'withFile: resource busy (file is locked)') "
        "OR contains(trace, 'copyFileToHandle:openFile: resource busy (file is locked)')",
    ),
    ("code_-4", "error code: -4", "contains(trace, 'Command failed with error code: -4')"),
    (
        "wasm_ghc-pkg",
        "wasm32-wasi-ghc-pkg recache",
        "contains(trace, 'wasm32-wasi-ghc-pkg: createProcess: exec: invalid argument (Bad file descriptor)')",
    ),
]
_REGEX = [
    ("signal_9", "received signal 9", "failed due to signal 9 .Killed"),
    (
        "cannot_allocate",
        "could not allocate memory",
        "osCommitMemory: VirtualAlloc MEM_COMMIT failed|out of memory allocating [0-9]+ bytes",
    ),
    ("submodule_clone", "Submodule clone failure", "Failed to clone ''.*'' a second time, aborting"),
    ("cabal_hadrian_segfault", '"cabal exec hadrian" segfault', "Segmentation fault.*CABAL.*new-exec.*hadrian"),
    ("ghc-config_file_conflict", "ghc-config file conflict", "posix_spawnp: resource busy"),
    ("code_-11", "error code: -11", "Command failed with error code: -11"),
    ("ulimit", "ulimit: Invalid argument", "ulimit: virtual memory: cannot modify limit: Invalid argument"),
    ("sigquit", "death by SIGQUIT", "^SIGQUIT: quit"),
]
_PATTERN = [(c, m, f"regexp_matches(trace, '(?m){p}')") for c, m, p in _REGEX]
_REASON = [
    ("job_timeout", "job timeout", "failure_reason = 'stuck_or_timeout_failure'"),
    ("runner_system", "runner failure", "failure_reason = 'runner_system_failure'"),
]


def _hits(checks, source: str = "job_log") -> str:
    return " UNION ALL ".join(
        f"SELECT job_id, '{code}' AS type, '{message}' AS message FROM {source} WHERE {test}"
        for code, message, test in checks
    )


_HIT = _hits(_REASON + _LITERAL + _PATTERN)

_EVENT = """
SELECT CAST(json_extract_string(payload, '$.build_id') AS BIGINT) AS build_id,
  json_extract_string(payload, '$.build_status') AS build_status,
  CAST(json_extract_string(payload, '$.project_id') AS BIGINT) AS project_id,
  CAST(replace(json_extract_string(payload, '$.build_finished_at'), ' UTC', '') AS TIMESTAMP) AS build_finished_at
FROM job_event WHERE json_exists(payload, '$.build_id')"""

_JOB_OK = """(coalesce(json_type(job_blob, '$.runner'), 'NULL') = 'NULL'
  OR (json_exists(job_blob, '$.runner.id') AND json_exists(job_blob, '$.runner.description')))"""

_DECODED = f"""
SELECT job_id,
  json_extract_string(job_blob, '$.web_url') AS web_url,
  CAST(json_extract_string(job_blob, '$.runner.id') AS BIGINT) AS runner_id,
  json_extract_string(job_blob, '$.runner.description') AS runner_name,
  CAST(rtrim(json_extract_string(job_blob, '$.created_at'), 'Z') AS TIMESTAMP) AS created_at,
  CAST(rtrim(json_extract_string(job_blob, '$.finished_at'), 'Z') AS TIMESTAMP) AS finished_at,
  json_extract_string(job_blob, '$.failure_reason') AS failure_reason,
  json_extract_string(job_blob, '$.name') AS job_name,
  json_extract_string(job_blob, '$.status') AS status
FROM job WHERE {_JOB_OK}"""

_PROJECTS = """
SELECT CAST(json_extract_string(payload, '$.id') AS BIGINT) AS project_id,
  json_extract_string(payload, '$.path_with_namespace') AS project_path FROM project"""

_FINISHED = """
SELECT e.build_id AS job_id, e.build_status, e.project_id, p.project_path, j.web_url, j.runner_id, j.runner_name,
  j.created_at, j.finished_at, j.failure_reason, j.job_name
FROM event e JOIN decoded j ON j.job_id = e.build_id JOIN projects p ON p.project_id = e.project_id
WHERE e.build_finished_at IS NOT NULL AND j.finished_at IS NOT NULL"""

_ENRICHED = {"event": _EVENT, "decoded": _DECODED, "projects": _PROJECTS, "finished": _FINISHED, "hit": _HIT}
_ENRICHED_VIEWS = "job_event job project job_log"

# A canonical object has its keys in order: the fields of the job view, sorted.
_CANONICAL = """
SELECT job_id,
  '{"created_at":"' || json_extract_string(job_blob, '$.created_at')
  || '","failure_reason":' || CAST(json_extract(job_blob, '$.failure_reason') AS VARCHAR)
  || ',"finished_at":' || CAST(json_extract(job_blob, '$.finished_at') AS VARCHAR)
  || ',"id":' || json_extract_string(job_blob, '$.id')
  || ',"name":"' || json_extract_string(job_blob, '$.name') || '"'
  || CASE WHEN NOT json_exists(job_blob, '$.runner') THEN ''
          WHEN json_type(job_blob, '$.runner') = 'NULL' THEN ',"runner":null'
          WHEN NOT json_exists(job_blob, '$.runner.description')
            THEN ',"runner":{"id":' || json_extract_string(job_blob, '$.runner.id') || '}'
          ELSE ',"runner":{"description":"' || json_extract_string(job_blob, '$.runner.description')
            || '","id":' || json_extract_string(job_blob, '$.runner.id') || '}' END
  || ',"status":"' || json_extract_string(job_blob, '$.status')
  || '","web_url":"' || json_extract_string(job_blob, '$.web_url') || '"}' AS job_blob
FROM job"""

_STORED_LOG = "SELECT job_id FROM job_log WHERE job_id % 4 <> 0"

# Index rows of a job: url present only for decodable jobs.
_INDEX_ROW = "SELECT job_id, web_url AS job_url FROM decoded"

_NORM = r"""
SELECT job_id, ' ' || trim(regexp_replace(strip_accents(lower(trace)), '[^\p{L}\p{N}\p{Co}]+', ' ', 'g')) || ' ' AS norm
FROM job_log"""

_TERM = """
SELECT term, job_id, CAST(pos AS INTEGER) AS pos FROM (
  SELECT job_id, unnest(words) AS term, unnest(range(len(words))) AS pos
  FROM (SELECT job_id, string_split(trim(norm), ' ') AS words FROM norm) w) t
WHERE term <> ''"""


def _search(condition: str) -> str:
    return with_views("job_log", f"SELECT job_id FROM norm WHERE {condition}", norm=_NORM)


_NESTED = (
    "(contains(norm, ' failed to connect ') OR contains(norm, ' cannot modi') OR starts_with(norm, ' el ')) "
    "AND NOT (contains(norm, ' failed ') AND contains(norm, ' gitl'))"
)


def _index(body: str) -> str:
    return with_views("job_log", body, norm=_NORM, term=_TERM)


_RESULT = """
SELECT j.job_id, CAST(rtrim(json_extract_string(job_blob, '$.created_at'), 'Z') AS TIMESTAMP) AS created_at,
  web_url AS job_url, CAST(json_extract_string(job_blob, '$.runner.id') AS BIGINT) AS runner_id,
  json_extract_string(job_blob, '$.runner.description') AS runner_name,
  json_extract_string(job_blob, '$.name') AS job_name
FROM job j WHERE job_id IN (SELECT job_id FROM norm WHERE contains(norm, '{needle}'))"""

_LINES = r"""
SELECT job_id, CAST(i AS BIGINT) AS line_no, line FROM (
  SELECT job_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i
  FROM (SELECT job_id, string_split(regexp_replace(trace, '\n\z', ''), chr(10)) AS lines FROM job_log) s) l
WHERE regexp_matches(line, '[Ff]ailed|error')"""

_TESTS = r"""
SELECT DISTINCT test_name FROM (
  SELECT unnest(string_split(names, ' ')) AS test_name FROM (
    SELECT unnest(regexp_extract_all(trace, '(?m)^TEST="([^"\n]*)"', 1)) AS names FROM job_log) n) t
WHERE test_name <> ''"""

_WINDOWS = """
SELECT id, started_at FROM ci_build
WHERE name LIKE '%windows%' AND project_id = 1 AND started_at IS NOT NULL AND status = 'failed'
  AND started_at > TIMESTAMP '2024-01-02'"""

_KIND = """
SELECT event_id,
  CASE WHEN json_exists(payload, '$.event_name') AND json_exists(payload, '$.project_id')
    THEN CASE json_extract_string(payload, '$.event_name') WHEN 'project_create' THEN 'project_create'
         ELSE 'other_project' END
    ELSE 'other' END AS kind,
  CASE WHEN json_exists(payload, '$.event_name') AND json_exists(payload, '$.project_id')
    THEN CAST(json_extract_string(payload, '$.project_id') AS BIGINT) END AS project_id
FROM system_event"""

_SETTINGS = """'http://127.0.0.1:8080/hook' AS url, true AS job_events, false AS push_events,
  false AS enable_ssl_verification"""

_HOOKED = "SELECT 1 FROM hook h WHERE h.project_id = p.project_id AND contains(h.url, ':8080')"


def _budget(commands: str, order: str = "ts, seq") -> dict[str, str]:
    """The budget by two passes of window functions: runs between resets, then the place in the run."""
    return {
        "runs": f"""
SELECT *, coalesce(sum(CASE WHEN cmd = 'clear' OR NOT accepted THEN 1 ELSE 0 END) OVER (
    PARTITION BY root ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
FROM {commands}""",
        "placed": f"""
SELECT *, (row_number() OVER (PARTITION BY root, run ORDER BY {order}) - 1) % 11 AS used
FROM runs WHERE cmd = 'retry'""",
        "decided": """
SELECT *, CASE WHEN used >= 10 THEN 'exceeded' WHEN NOT accepted THEN 'request_failed' ELSE 'retry' END AS decision,
  CASE WHEN used < 10 AND accepted THEN CAST(9 - used AS BIGINT) END AS retries_remaining
FROM placed""",
    }


_DECISIONS = "SELECT root, ts, seq, cmd, accepted, decision, retries_remaining FROM decided"

_LINK = """
SELECT job_id, CAST(json_extract_string(payload, '$.id') AS BIGINT) AS new_job_id
FROM retry_response WHERE json_exists(payload, '$.id')"""


def _lineage(link: str) -> str:
    return f"""
SELECT job_id, job_id AS root, CAST(0 AS BIGINT) AS depth FROM {link}
WHERE job_id NOT IN (SELECT new_job_id FROM {link})
UNION
SELECT l.new_job_id, p.root, p.depth + 1 FROM lineage p JOIN {link} l ON l.job_id = p.job_id"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_ROOTED = """
SELECT c.job_id, coalesce(p.root, c.job_id) AS root, c.ts, c.job_id AS seq, c.cmd,
  k.new_job_id IS NOT NULL AS accepted, k.new_job_id
FROM job_cmd c LEFT JOIN lineage p ON p.job_id = c.job_id LEFT JOIN link k ON k.job_id = c.job_id"""

_BOOKS = """
SELECT job_id, root, decision, CASE WHEN decision = 'retry' THEN new_job_id END AS new_job_id, retries_remaining,
  CAST(job_id AS VARCHAR) || ':finished:failed:retrying:' || CASE decision
    WHEN 'retry' THEN 'continued by ' || CAST(new_job_id AS VARCHAR) || ', left '
      || CAST(retries_remaining AS VARCHAR)
    WHEN 'exceeded' THEN 'no retry left'
    ELSE 'no new job for ' || CAST(job_id AS VARCHAR) END AS note
FROM decided"""

_FAILURE_ROWS = """
SELECT f.job_id, h.type, f.finished_at AS job_date, f.web_url, f.runner_id, f.runner_name, f.job_name, f.project_path
FROM finished f JOIN hit h ON h.job_id = f.job_id WHERE f.build_status = 'failed'"""

_AGES = """
SELECT CAST(floor(job_id / 100) AS BIGINT) AS page, count(*) AS jobs,
  CASE WHEN bool_and(created_at > TIMESTAMP '2024-01-03') THEN 'too_young'
       WHEN bool_and(created_at < TIMESTAMP '2024-01-02') THEN 'too_old' ELSE 'found' END AS age
FROM job GROUP BY 1"""

_IN_RANGE = """
SELECT job_id, created_at, status FROM job
WHERE status IN ('failed', 'success') AND project_id = 1 AND created_at BETWEEN TIMESTAMP '{}' AND TIMESTAMP '{}'"""


def _near(phrases: list[str], distance: int) -> str:
    tables, body = _near_parts(phrases, distance)
    return with_views("job_log", body, norm=_NORM, term=_TERM, **tables)


def _near_parts(phrases: list[str], distance: int) -> tuple[dict[str, str], str]:
    """One row per phrase occurrence; a match is a choice of one each, close enough to the last start."""
    names = [f"p{i}" for i in range(len(phrases))]
    tables = {}
    for name, text in zip(names, phrases):
        words = text.split()
        joins = " ".join(
            f"JOIN term t{i} ON t{i}.job_id = t0.job_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'"
            for i, w in enumerate(words)
            if i
        )
        tables[name] = f"SELECT t0.job_id, t0.pos AS start FROM term t0 {joins} WHERE t0.term = '{words[0]}'"
    last = "greatest(" + ", ".join(f"{n}.start" for n in names) + ")"
    close = " AND ".join(f"{last} - {n}.start - {len(p.split())} <= {distance}" for n, p in zip(names, phrases))
    joined = " ".join(
        f"JOIN {n} ON {n}.job_id = p0.job_id AND abs({n}.start - p0.start) <= {distance + 10}" for n in names[1:]
    )
    return tables, f"SELECT DISTINCT p0.job_id FROM p0 {joined} WHERE {close}"


_NEAR_TABLES, _NEAR_BODY = _near_parts(["que", "la", "de"], 4)
_FIRST_PAGE = (
    "SELECT * EXCLUDE (n), n > 50 AS has_next FROM (SELECT *, row_number() OVER "
    "(ORDER BY created_at DESC, job_id DESC) AS rank, count(*) OVER () AS n FROM result) p WHERE rank <= 50"
)


ORACLE: dict[str, str] = {
    "classify_literal": with_views("job_log", _hits(_LITERAL)),
    "classify_regex": with_views("job_log", _hits(_PATTERN)),
    "classify_reason": with_views("job_log", _hits(_REASON)),
    "classify_all": with_views("job_log", _HIT),
    "unclassified": with_views(
        "job_log", "SELECT job_id FROM job_log WHERE job_id NOT IN (SELECT job_id FROM hit)", hit=_HIT
    ),
    "enum_gap": with_views(
        "job_log",
        "SELECT type, count(*) AS failures FROM hit "
        "WHERE type IN ('sigquit', 'hadrian_locked_file', 'code_-4', 'wasm_ghc-pkg') GROUP BY type",
        hit=_HIT,
    ),
    "event_decode": with_views("job_event", "SELECT * FROM event", event=_EVENT),
    "event_quarantine": with_views(
        "job_event", "SELECT event_id, payload FROM job_event WHERE NOT json_exists(payload, '$.build_id')"
    ),
    "finished_events": with_views(
        "job_event", "SELECT * FROM event WHERE build_finished_at IS NOT NULL", event=_EVENT
    ),
    "status_dispatch": with_views(
        "job_event",
        "SELECT build_id, build_status, project_id, "
        "CASE build_status WHEN 'failed' THEN 'failed' ELSE 'other' END AS status_kind, true AS to_index, "
        "build_status = 'failed' AS to_classify FROM event WHERE build_finished_at IS NOT NULL",
        event=_EVENT,
    ),
    "system_event_kind": with_views("system_event", _KIND),
    "reason_normalise": with_views(
        "job_log",
        "SELECT job_id, CASE failure_reason WHEN 'job_execution_timeout' THEN 'timeout' "
        "WHEN 'stuck_or_timeout_failure' THEN 'stuck' WHEN 'runner_system_failure' THEN 'runner_system' "
        "WHEN 'script_failure' THEN 'other' END AS kind, failure_reason AS reason FROM job_log",
    ),
    "job_decode": with_views("job", _DECODED),
    "job_quarantine": with_views("job", f"SELECT job_id FROM job WHERE NOT {_JOB_OK}"),
    "json_extract": with_views(
        "job",
        "SELECT job_id, json_extract_string(job_blob, '$.created_at') AS created_at, "
        "json_extract_string(job_blob, '$.name') AS name, "
        "CAST(json_extract_string(job_blob, '$.runner.id') AS BIGINT) AS runner_id, "
        "json_extract_string(job_blob, '$.runner.description') AS runner_name FROM job",
    ),
    "json_canonical": with_views("job", _CANONICAL),
    "job_enrich": with_views(_ENRICHED_VIEWS, "SELECT * FROM finished", **_ENRICHED),
    "finish_quarantine": with_views(
        "job_event job",
        "SELECT * FROM event WHERE build_finished_at IS NOT NULL "
        "AND build_id IN (SELECT job_id FROM decoded WHERE finished_at IS NULL)",
        event=_EVENT,
        decoded=_DECODED,
    ),
    "failure_rows": with_views(_ENRICHED_VIEWS, _FAILURE_ROWS, **_ENRICHED),
    "retry_commands": with_views(
        _ENRICHED_VIEWS,
        "SELECT job_id, project_id, finished_at AS ts, CASE WHEN build_status = 'failed' "
        "AND job_id IN (SELECT job_id FROM hit) THEN 'retry' ELSE 'clear' END AS cmd FROM finished",
        **_ENRICHED,
    ),
    "retry_candidates": with_views(
        _ENRICHED_VIEWS,
        "SELECT job_id, project_id, job_id IN (SELECT job_id FROM hit) AS retry FROM finished "
        "WHERE build_status = 'failed'",
        **_ENRICHED,
    ),
    "failure_upsert": with_views("job_log", "SELECT job_id, type FROM hit WHERE job_id % 2 <> 0", hit=_HIT),
    "job_upsert": with_views(
        "job",
        "SELECT d.job_id, d.web_url AS job_url, d.created_at, c.job_blob FROM decoded d "
        "JOIN canonical c ON c.job_id = d.job_id WHERE d.job_id % 3 <> 0",
        decoded=_DECODED,
        canonical=_CANONICAL,
    ),
    "failure_import": with_views(
        "job job_log",
        "SELECT h.job_id, h.type, d.created_at AS job_date, d.web_url, d.runner_id, CAST(NULL AS VARCHAR) AS runner_name, "
        "CAST(NULL AS VARCHAR) AS job_name, CAST(NULL AS VARCHAR) AS project_path "
        "FROM hit h JOIN decoded d ON d.job_id = h.job_id",
        decoded=_DECODED,
        hit=_HIT,
    ),
    "log_backlog": with_views(
        "job job_log",
        "SELECT j.job_id, j.job_url || '/raw' AS log_url FROM idx j LEFT JOIN stored s ON s.job_id = j.job_id "
        "WHERE s.job_id IS NULL",
        decoded=_DECODED,
        idx=_INDEX_ROW,
        stored=_STORED_LOG,
    ),
    "log_backlog_size": with_views(
        "job job_log",
        "SELECT count(*) AS jobs FROM idx WHERE job_id NOT IN (SELECT job_id FROM stored)",
        decoded=_DECODED,
        idx=_INDEX_ROW,
        stored=_STORED_LOG,
    ),
    "backfill_range": with_views("job", _IN_RANGE.format("2024-01-02", "2024-01-03")),
    "backfill_default_range": with_views("job", _IN_RANGE.format("2024-01-02 12:00:00", "2024-02-01 12:00:00")),
    "page_age_class": with_views("job", _AGES),
    "archive_backfill": with_views(
        "job job_log",
        "SELECT job_id, count(*) AS tokens FROM term WHERE job_id IN (SELECT r.job_id FROM in_range r "
        "JOIN decoded d ON d.job_id = r.job_id) GROUP BY job_id",
        norm=_NORM,
        term=_TERM,
        decoded=_DECODED,
        in_range=_IN_RANGE.format("2024-01-02", "2024-01-03"),
    ),
    "archive_search": with_views(
        "job job_log",
        "SELECT * EXCLUDE (n), n > 50 AS has_next FROM (SELECT *, row_number() OVER "
        "(ORDER BY created_at DESC, job_id DESC) AS rank, count(*) OVER () AS n FROM result "
        "WHERE job_id IN (SELECT r.job_id FROM in_range r JOIN decoded d ON d.job_id = r.job_id)) p WHERE rank <= 50",
        norm=_NORM,
        decoded=_DECODED,
        in_range=_IN_RANGE.format("2024-01-02", "2024-01-03"),
        result=_RESULT.format(needle=" failed ").replace(
            "contains(norm, ' failed ')", "contains(norm, ' failed ') OR contains(norm, ' error ')"
        ),
    ),
    "own_check": with_views(
        "job_log",
        "SELECT job_id, 'long_log' AS type, 'more than 3000 characters' AS message FROM job_log WHERE length(trace) > 3000 "
        "UNION ALL SELECT job_id, 'stuck_or_11', 'stuck, or error -11' FROM job_log "
        "WHERE coalesce(failure_reason = 'stuck_or_timeout_failure', false) OR contains(trace, '-11')",
    ),
    "listing_pages": with_views(
        "job",
        "SELECT job_id, status, CAST(rtrim(json_extract_string(job_blob, '$.created_at'), 'Z') AS TIMESTAMP) AS created_at, "
        "web_url FROM job",
    ),
    "rows_added": with_views(
        "job",
        "SELECT 'job' AS table_name, 'part-' || CAST(job_id % 4 AS VARCHAR) AS batches, count(*) AS rows FROM decoded GROUP BY job_id % 4",
        decoded=_DECODED,
    ),
    "merged_jobs": with_views("job", "SELECT job_id, web_url AS job_url, created_at FROM decoded", decoded=_DECODED),
    "store_contents": with_views(
        "job job_log",
        "SELECT t AS table_name, CAST(CASE t WHEN 'job' THEN (SELECT count(*) FROM staged) "
        "WHEN 'job_log' THEN (SELECT count(*) FROM job_log WHERE job_id IN (SELECT job_id FROM staged)) "
        "WHEN 'log_term' THEN (SELECT count(*) FROM term WHERE job_id IN (SELECT job_id FROM staged)) ELSE 0 END AS BIGINT) AS rows "
        "FROM (SELECT unnest(['ci_failure', 'job', 'job_log', 'retry_command', 'retry_decision', 'lineage_count', "
        "'budget_command', 'event', 'pending_event', 'retry_link', 'job_root', 'log_term']) AS t)",
        norm=_NORM,
        term=_TERM,
        decoded=_DECODED,
        in_range=_IN_RANGE.format("2024-01-02", "2024-01-03"),
        staged="SELECT r.job_id FROM in_range r JOIN decoded d ON d.job_id = r.job_id",
    ),
    "tokenise": with_views("job_log", _NORM),
    "term_index": _index("SELECT * FROM term"),
    "search_phrase": _search("contains(norm, ' failed to connect to gitlab ')"),
    "search_concat": _search("contains(norm, ' cannot connect to the docker ')"),
    "search_all": _search("contains(norm, ' failed ') AND contains(norm, ' hard 3 ')"),
    "search_any": _search("contains(norm, ' movefileex ') OR contains(norm, ' sigquit quit ')"),
    "search_not": _search("contains(norm, ' error code ') AND NOT contains(norm, ' 11 ')"),
    "search_prefix": _search("contains(norm, ' cannot modi')"),
    "search_initial": _search("starts_with(norm, ' el ')"),
    "search_near": _near(["que", "la", "de"], 4),
    "search_near_default": _near(["hard", "failed"], 10),
    "search_near_phrases": _near(["spawnp resource", "hard"], 3),
    "index_phrase": _search("contains(norm, ' command failed with error code ')"),
    "index_all": _search("contains(norm, ' failed ') AND contains(norm, ' connect ') AND contains(norm, ' t1 ')"),
    "index_any": _search("contains(norm, ' movefileex ') OR contains(norm, ' sigquit ')"),
    "index_not": _search("contains(norm, ' error ') AND NOT contains(norm, ' 11 ')"),
    "index_prefix": _search("contains(norm, ' movefile')"),
    "index_initial": _search("starts_with(norm, ' el ')"),
    "search_page": with_views(
        "job job_log",
        "SELECT * EXCLUDE (n), n > 100 AS has_next FROM (SELECT *, row_number() OVER "
        "(ORDER BY created_at DESC, job_id DESC) - 50 AS rank, count(*) OVER () AS n FROM result) r "
        "WHERE rank BETWEEN 1 AND 50",
        norm=_NORM,
        result=_RESULT.format(needle=" failed "),
    ),
    "search_page_after": with_views(
        "job job_log",
        "SELECT * EXCLUDE (n), n > 100 AS has_next FROM (SELECT *, row_number() OVER "
        "(ORDER BY created_at DESC, job_id DESC) - 50 AS rank, count(*) OVER () AS n FROM result) r "
        "WHERE rank BETWEEN 1 AND 50",
        norm=_NORM,
        result=_RESULT.format(needle=" failed "),
    ),
    "search_page_far": with_views(
        "job job_log",
        "SELECT job_id, created_at, rank, n > 50 AS has_next FROM (SELECT *, row_number() OVER "
        "(ORDER BY created_at DESC, job_id DESC) - 40 AS rank, count(*) OVER () AS n FROM result) r "
        "WHERE rank BETWEEN 1 AND 10",
        norm=_NORM,
        result=_RESULT.format(needle=" failed "),
    ),
    "search_last_page": with_views(
        "job job_log",
        "SELECT job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, job_url, "
        "coalesce(CAST(runner_id AS VARCHAR), 'N/A') AS runner_id, coalesce(runner_name, 'N/A') AS runner_name, "
        "job_name, n > 50 AS has_next, rank, job_url || '/raw' AS log_url FROM (SELECT *, row_number() OVER "
        "(ORDER BY created_at DESC, job_id DESC) AS rank, count(*) OVER () AS n FROM result) r WHERE rank <= 50",
        norm=_NORM,
        result=_RESULT.format(needle=" resource busy "),
    ),
    "search_index_page": with_views(
        "job job_log",
        "SELECT * EXCLUDE (n), n > 100 AS has_next FROM (SELECT *, row_number() OVER "
        "(ORDER BY created_at DESC, job_id DESC) - 50 AS rank, count(*) OVER () AS n FROM result) r "
        "WHERE rank BETWEEN 1 AND 50",
        norm=_NORM,
        result=_RESULT.format(needle=" failed "),
    ),
    "search_nested": _search(_NESTED),
    "compacted_search": _search(_NESTED),
    "search_near_page": with_views(
        "job job_log",
        _FIRST_PAGE,
        norm=_NORM,
        term=_TERM,
        **_NEAR_TABLES,
        near=_NEAR_BODY,
        result=_RESULT.format(needle=" hard 3 ").replace(
            "job_id IN (SELECT", "job_id IN (SELECT job_id FROM near) AND job_id NOT IN (SELECT"
        ),
    ),
    "search_empty_keyword": "SELECT CAST(0 AS BIGINT) AS matches",
    "search_count": with_views(
        "job_log", "SELECT count(*) AS matches FROM norm WHERE contains(norm, ' failed ')", norm=_NORM
    ),
    "grep_logs": with_views(
        "job job_log",
        "SELECT g.job_id, coalesce(l.line_no, 0) AS line_no, CAST(g.job_id AS VARCHAR) || ':' || coalesce(l.line, '') AS line "
        "FROM (SELECT j.job_id FROM job j JOIN job_log k ON k.job_id = j.job_id WHERE j.status = 'failed') g "
        "LEFT JOIN found l ON l.job_id = g.job_id ORDER BY CAST(g.job_id AS VARCHAR) DESC, 2",
        found=_LINES,
    ),
    "grep_indexed": with_views(
        "job_log",
        "SELECT g.job_id, coalesce(l.line_no, 0) AS line_no, CAST(g.job_id AS VARCHAR) || ':' || coalesce(l.line, '') AS line "
        "FROM job_log g LEFT JOIN found l ON l.job_id = g.job_id",
        found=_LINES,
    ),
    "raw_log_source": with_views(
        "job job_log",
        "SELECT l.job_id, strlen(l.trace) + CASE WHEN l.job_id % 19 = 0 THEN 1 ELSE 0 END AS size, "
        "CASE WHEN l.job_id % 19 <> 0 THEN md5(l.trace) END AS digest "
        "FROM job_log l JOIN job j ON j.job_id = l.job_id WHERE j.status = 'failed'",
    ),
    "raw_log_grep": with_views(
        "job_log",
        "SELECT g.job_id, coalesce(l.line_no, 0) AS line_no, CAST(g.job_id AS VARCHAR) || ':' || coalesce(l.line, '') AS line "
        "FROM job_log g LEFT JOIN found l ON l.job_id = g.job_id WHERE g.job_id % 19 <> 0",
        found=_LINES,
    ),
    "failing_tests": with_views("job_log", f"{_TESTS} ORDER BY test_name"),
    "stat_test_kinds": with_views(
        "job_log test_def",
        "SELECT 'collect_stats' AS kind, count(*) FILTER (contains(kind, 'collect_stats')) AS lines FROM test_def "
        "WHERE test_name IN (SELECT test_name FROM failing) UNION ALL "
        "SELECT 'collect_compiler', count(*) FILTER (contains(kind, 'collect_compiler')) FROM test_def "
        "WHERE test_name IN (SELECT test_name FROM failing)",
        failing=_TESTS,
    ),
    "windows_failed_jobs": with_views("ci_build", f"{_WINDOWS} ORDER BY started_at DESC, id DESC"),
    "windows_logs_to_fetch": with_views(
        "ci_build job_log",
        "SELECT id AS job_id, started_at FROM windows w WHERE id NOT IN (SELECT job_id FROM stored)",
        windows=_WINDOWS,
        stored=_STORED_LOG,
    ),
    "hook_missing": with_views(
        "audit_project hook", f"SELECT * FROM audit_project p WHERE NOT EXISTS ({_HOOKED}) ORDER BY project_id DESC"
    ),
    "hook_present": with_views(
        "audit_project hook", f"SELECT * FROM audit_project p WHERE EXISTS ({_HOOKED}) ORDER BY project_id DESC"
    ),
    "hook_plan": with_views(
        "system_event", f"SELECT project_id, {_SETTINGS} FROM kind WHERE kind = 'project_create'", kind=_KIND
    ),
    "hook_plan_audit": with_views(
        "audit_project hook", f"SELECT project_id, {_SETTINGS} FROM audit_project p WHERE NOT EXISTS ({_HOOKED})"
    ),
    "retry_budget": with_views("retry_cmd", _DECISIONS, **_budget("retry_cmd")),
    "retry_lineage": _recursive(
        with_views("retry_response", "SELECT * FROM lineage", link=_LINK, lineage=_lineage("link"))
    ),
    "retry_lineage_conversations": _recursive(
        with_views("conversation_link", "SELECT * FROM lineage", lineage=_lineage("conversation_link"))
    ),
    "retry_bookkeeping": _recursive(
        with_views(
            "retry_response job_cmd",
            _BOOKS,
            link=_LINK,
            lineage=_lineage("link"),
            rooted=_ROOTED,
            **_budget("rooted"),
        )
    ),
    "project_quarantine": with_views(
        "project_delivery", "SELECT * FROM project_delivery WHERE delivery % 9 IN (0, 4, 6)"
    ),
    "retry_response_quarantine": with_views(
        "retry_response", "SELECT job_id FROM retry_response WHERE NOT json_exists(payload, '$.id')"
    ),
    "stat_tests_from_source": with_views(
        "source_file",
        "SELECT 'collect_stats' AS kind, coalesce(sum(contains(text, 'collect_stats')::INT), 0)::BIGINT AS lines FROM counted "
        "UNION ALL SELECT 'collect_compiler', coalesce(sum(contains(text, 'collect_compiler')::INT), 0)::BIGINT FROM counted",
        raw="SELECT file, unnest(string_split(text, chr(10))) AS line, "
        "unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM source_file",
        line="SELECT file, line_no, line || CASE WHEN (file + line_no) % 5 = 0 THEN ' collect_stats' "
        "WHEN (file + line_no) % 7 = 0 THEN ' collect_compiler_x' ELSE '' END AS text FROM raw",
        test="SELECT unnest(['the', 'que', 'der', 'thnt']) AS test_name",
        named=r"SELECT file, line_no, test_name FROM line, test "
        r"WHERE list_contains(regexp_extract_all(text, '[\p{L}\p{N}_]+'), test_name)",
        counted="SELECT DISTINCT l.file, l.line_no, n.test_name, l.text FROM line l JOIN named n "
        "ON n.file = l.file AND l.line_no BETWEEN n.line_no AND n.line_no + 3",
    ),
    "stat_tests_substring": with_views(
        "job_log",
        "SELECT 'collect_stats' AS kind, count(*) AS lines FROM counted WHERE contains(text, 'collect_stats') "
        "UNION ALL SELECT 'collect_compiler', count(*) FROM counted WHERE contains(text, 'collect_compiler')",
        test=_TESTS,
        raw="SELECT job_id AS file, unnest(string_split(trace, chr(10))) AS line, "
        "unnest(range(1, len(string_split(trace, chr(10))) + 1)) AS line_no FROM job_log",
        line="SELECT file, line_no, line || CASE WHEN (file + line_no) % 5 = 0 THEN ' collect_stats' ELSE '' END AS text FROM raw",
        named="SELECT file, line_no, test_name FROM line JOIN test ON contains(text, test_name)",
        counted="SELECT DISTINCT l.file, l.line_no, n.test_name, l.text FROM line l JOIN named n "
        "ON n.file = l.file AND l.line_no BETWEEN n.line_no AND n.line_no + 3",
    ),
    "stream_dedupe": with_views(
        "job_event", "SELECT * FROM event WHERE build_finished_at IS NOT NULL", event=_EVENT
    ),
    "stream_retry": with_views(
        "retry_cmd",
        "SELECT root, ts, seq, decision, retries_remaining FROM decided",
        **_budget("retry_cmd", "seq % 4, ts, seq"),
    ),
    "stream_retry_batches": with_views(
        "retry_cmd", "SELECT root, ts, seq, decision, retries_remaining FROM decided", **_budget("retry_cmd")
    ),
    "stream_triage": with_views(_ENRICHED_VIEWS, _FAILURE_ROWS, **_ENRICHED),
    "stream_pending": with_views(
        "job_event job project",
        "SELECT e.* FROM event e LEFT JOIN decoded j ON j.job_id = e.build_id LEFT JOIN projects p USING (project_id) "
        "WHERE e.build_finished_at IS NOT NULL AND (j.job_id IS NULL OR (j.finished_at IS NOT NULL "
        "AND (p.project_id IS NULL OR (e.build_status = 'failed' AND e.build_id % 7 = 0))))",
        event=_EVENT,
        decoded=_DECODED,
        projects=_PROJECTS,
    ),
    "stream_triage_decisions": _recursive(
        with_views(
            f"{_ENRICHED_VIEWS} retry_response",
            "SELECT root, ts, seq, decision, retries_remaining FROM decided",
            **_ENRICHED,
            link=_LINK,
            lineage=_lineage("link"),
            job_cmd="""
SELECT job_id, finished_at AS ts, CASE WHEN build_status = 'failed' AND job_id IN (SELECT job_id FROM hit)
  THEN 'retry' ELSE 'clear' END AS cmd FROM finished
UNION ALL
SELECT e.build_id, e.build_finished_at, 'clear' FROM event e JOIN decoded j ON j.job_id = e.build_id
WHERE e.build_finished_at IS NOT NULL AND j.finished_at IS NULL""",
            rooted=_ROOTED,
            **_budget("rooted", "seq % 4, ts, seq"),
        )
    ),
}
