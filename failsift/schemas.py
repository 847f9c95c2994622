"""Record schemas and the label sets of the failure table."""

from __future__ import annotations

JOB_EVENT = "build_id BIGINT, build_status STRING, project_id BIGINT, build_finished_at STRING"

JOB = (
    "id BIGINT, web_url STRING, runner STRUCT<id: BIGINT, description: STRING>, "
    "created_at STRING, finished_at STRING, failure_reason STRING, name STRING, "
    "status STRING, pipeline STRUCT<source: STRING, project_id: BIGINT>"
)

PROJECT = "id BIGINT, path_with_namespace STRING"

SYSTEM_EVENT = "event_name STRING, project_id BIGINT"

RETRY_RESULT = "id BIGINT"

HOOK = "id BIGINT, url STRING, project_id BIGINT"

CI_FAILURE = (
    "job_id BIGINT, type STRING, job_date TIMESTAMP, web_url STRING, runner_id BIGINT, "
    "runner_name STRING, job_name STRING, project_path STRING"
)

JOB_TABLE = "job_id BIGINT, job_url STRING, created_at TIMESTAMP, job_blob STRING"

JOB_LOG = "job_id BIGINT, trace STRING, norm STRING"

LOG_TERM = "term STRING, job_id BIGINT, pos INT"

RETRY_DECISION = "root BIGINT, ts TIMESTAMP, seq BIGINT, decision STRING, retries_remaining BIGINT"

LINEAGE_COUNT = "root BIGINT, used BIGINT, gone BOOLEAN, stream STRING, batch_no BIGINT"

BUDGET_COMMAND = "root BIGINT, ts TIMESTAMP, seq BIGINT, cmd STRING, accepted BOOLEAN"

FINISHED_EVENT = "build_id BIGINT, build_status STRING, project_id BIGINT, build_finished_at TIMESTAMP"

PENDING_EVENT = FINISHED_EVENT + ", gone BOOLEAN, stream STRING, batch_no BIGINT"

RETRY_LINK = "job_id BIGINT, new_job_id BIGINT"

JOB_ROOT = "job_id BIGINT, root BIGINT"

RETRY_COMMAND = "job_id BIGINT, project_id BIGINT, ts TIMESTAMP, cmd STRING"

# The labels the stored failure type admits.
STORED_LABELS = (
    "type",
    "submodule_clone",
    "MoveFileEx",
    "signal_9",
    "no_space",
    "cabal_hadrian_segfault",
    "ulimit",
    "connect_gitlab",
    "perf_note_fetch",
    "ghc-pkg_died",
    "repo_clone",
    "T16916",
    "pull_image",
    "ghc-config_file_conflict",
    "cannot_allocate",
    "job_timeout",
    "nix_T7273",
    "runner_process_terminated",
    "code_-11",
    "docker",
    "runner_system",
    "stack_T6388",
)

# Failure reasons with a meaning of their own; any other text passes through.
REASON_TIMEOUT = "job_execution_timeout"
REASON_STUCK = "stuck_or_timeout_failure"
REASON_RUNNER = "runner_system_failure"

# Fixed value: the one build status that leads to classification.
STATUS_FAILED = "failed"

# Fixed value: the system event that asks for a hook.
EVENT_PROJECT_CREATE = "project_create"
