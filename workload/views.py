"""Inputs of the queries, derived from the given tables.

Every view is plain SQL that Spark and the checking engine both take as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_REASON = """CASE WHEN doc_id % 31 = 0 THEN 'stuck_or_timeout_failure'
       WHEN doc_id % 37 = 0 THEN 'runner_system_failure'
       WHEN doc_id % 41 = 0 THEN 'job_execution_timeout'
       WHEN doc_id % 43 = 0 THEN 'script_failure' END"""

VIEWS = {
    # Texts the signatures look for. Arms 20 and 21 must not match: CR before SIGQUIT, LF inside the segfault text.
    "job_log": f"""
SELECT doc_id AS job_id,
  text || chr(10) || CASE doc_id % 29
    WHEN 0 THEN 'Cannot connect to the Docker daemon at unix:///var/run/docker.sock'
    WHEN 1 THEN 'Failed to connect to gitlab.haskell.org'
    WHEN 2 THEN 'failed due to signal 9 (Killed)'
    WHEN 3 THEN 'out of memory allocating 4096 bytes'
    WHEN 4 THEN 'MoveFileEx'
    WHEN 5 THEN 'Failed to clone ''x'' a second time, aborting'
    WHEN 6 THEN 'ghc-pkg dump failed: dieVerbatim: user error'
    WHEN 7 THEN 'cannot link ''/nix/store/.tmp-link'
    WHEN 8 THEN 'Segmentation fault a' || chr(13) || 'CABAL b new-exec c hadrian'
    WHEN 9 THEN 'ERROR: Job failed (system failure): aborted: terminated'
    WHEN 10 THEN 'posix_spawnp: resource busy'
    WHEN 11 THEN 'Command failed with error code: -11'
    WHEN 12 THEN 'ulimit: virtual memory: cannot modify limit: Invalid argument'
    WHEN 13 THEN 'fresh repository.' || chr(27) || '[0;m' || chr(10) || 'error'
    WHEN 14 THEN 'refs/notes/perf:refs/notes/perf' || chr(10) || 'error:'
    WHEN 15 THEN 'SIGQUIT: quit'
    WHEN 16 THEN 'Error: [S-922]'
    WHEN 17 THEN 'withFile: resource busy (file is locked)'
    WHEN 18 THEN 'Command failed with error code: -4'
    WHEN 19 THEN 'wasm32-wasi-ghc-pkg: createProcess: exec: invalid argument (Bad file descriptor)'
    WHEN 20 THEN 'x' || chr(13) || 'SIGQUIT: quit'
    WHEN 21 THEN 'Segmentation fault' || chr(10) || 'CABAL new-exec hadrian'
    WHEN 22 THEN 'MoveFileEx' || chr(10) || 'Error: [S-922]'
    ELSE '' END
  || chr(10) || 'TEST="T' || CAST(doc_id % 50 AS STRING) || ' hard_' || CAST(doc_id % 7 AS STRING) || '"' AS trace,
  {_REASON} AS failure_reason
FROM documents""",
    "job": f"""
SELECT d.doc_id AS job_id, d.doc_id % 5 + 1 AS project_id, e.ts AS created_at,
  CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'success' END AS status,
  'https://ci.example.org/jobs/' || CAST(d.doc_id AS STRING) AS web_url,
  '{{"id":' || CAST(d.doc_id AS STRING)
  || ',"web_url":"https://ci.example.org/jobs/' || CAST(d.doc_id AS STRING)
  || '","status":"' || CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'success' END
  || '","name":"' || CASE d.doc_id % 3 WHEN 0 THEN 'x86_64-windows-validate' WHEN 1 THEN 'x86_64-linux-deb10' ELSE 'lint-submods' END
  || '","created_at":"' || replace(substr(CAST(e.ts AS STRING), 1, 19), ' ', 'T') || 'Z"'
  || ',"failure_reason":' || coalesce('"' || d.reason || '"', 'null')
  || ',"finished_at":' || CASE WHEN d.doc_id % 13 = 0 THEN 'null'
       ELSE '"' || replace(substr(CAST(e.ts AS STRING), 1, 19), ' ', 'T') || '.250Z"' END
  || CASE WHEN d.doc_id % 11 = 0 THEN ',"runner":null' WHEN d.doc_id % 11 = 1 THEN ''
       WHEN d.doc_id % 53 = 0 THEN ',"runner":{{"id":7}}'
       ELSE ',"runner":{{"id":' || CAST(d.doc_id % 8 AS STRING) || ',"description":"runner-' || CAST(d.doc_id % 8 AS STRING) || '"}}' END
  || '}}' AS job_blob
FROM (SELECT doc_id, {_REASON} AS reason FROM documents) d JOIN events e ON e.event_id = d.doc_id""",
    "job_event": """
SELECT event_id, ts,
  '{"' || CASE WHEN event_id % 97 = 0 THEN 'buld_id' ELSE 'build_id' END || '":' || CAST(event_id AS STRING)
  || ',"build_status":"' || CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'success' END
  || '","project_id":' || CAST(user_id % 5 + 1 AS STRING)
  || ',"build_finished_at":' || CASE WHEN event_type = 'click' THEN 'null'
       ELSE '"' || substr(CAST(ts AS STRING), 1, 19) || ' UTC"' END || '}' AS payload
FROM events""",
    "system_event": """
SELECT event_id,
  CASE event_id % 4
    WHEN 0 THEN '{"event_name":"project_create","project_id":' || CAST(user_id AS STRING) || '}'
    WHEN 1 THEN '{"event_name":"project_destroy","project_id":' || CAST(user_id AS STRING) || '}'
    WHEN 2 THEN '{"event_name":"user_destroy","user_id":' || CAST(user_id AS STRING) || '}'
    ELSE '{"user_id":1}' END AS payload
FROM events""",
    "project": """
SELECT '{"id":' || CAST(r_regionkey + 1 AS STRING) || ',"path_with_namespace":"grp/' || lower(r_name) || '"}' AS payload
FROM region""",
    "project_delivery": """
SELECT c_custkey AS delivery, CASE c_custkey % 9 WHEN 0 THEN '{"id":' WHEN 4 THEN '{"id":7}'
  WHEN 6 THEN '{"path_with_namespace":"a/b"}'
  ELSE '{"id":' || CAST(c_custkey AS STRING) || ',"path_with_namespace":"grp/p"}' END AS payload
FROM customer""",
    "source_file": "SELECT doc_id AS file, text FROM documents",
    "audit_project": "SELECT c_custkey AS project_id, lower(c_name) AS path FROM customer",
    "hook": """
SELECT o_custkey AS project_id, o_orderkey AS hook_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'http://127.0.0.1:8080/hook' ELSE 'https://example.org/hook' END AS url
FROM orders""",
    "ci_build": """
SELECT event_id AS id,
  CASE event_id % 3 WHEN 0 THEN 'x86_64-windows-validate' WHEN 1 THEN 'x86_64-linux-deb10' ELSE 'lint-submods' END AS name,
  user_id % 5 + 1 AS project_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'success' END AS status,
  CASE WHEN event_id % 17 <> 0 THEN ts END AS started_at
FROM events""",
    # One lineage per user, ordered by time; some requests fail, some commands clear.
    "retry_cmd": """
SELECT user_id AS root, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'clear' ELSE 'retry' END AS cmd,
  NOT (event_type = 'error' AND event_id % 11 = 0) AS accepted
FROM events""",
    # Chains of 23 jobs: longer than two budgets.
    "retry_response": """
SELECT event_id AS job_id,
  CASE WHEN event_id % 23 = 22 THEN '{"message":"403 Forbidden"}'
       ELSE '{"id":' || CAST(event_id + 1 AS STRING) || ',"status":"pending","runner":null}' END AS payload
FROM events""",
    "job_cmd": """
SELECT event_id AS job_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'clear' ELSE 'retry' END AS cmd
FROM events""",
    "conversation_link": """
SELECT a.conv_id * 1000 + a.turn AS job_id, b.conv_id * 1000 + b.turn AS new_job_id
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "test_def": """
SELECT 'T' || CAST(p_partkey % 60 AS STRING) AS test_name,
  CASE p_partkey % 3 WHEN 0 THEN 'collect_stats' WHEN 1 THEN 'collect_compiler_stats' ELSE 'normal' END AS kind
FROM part""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    sql = VIEWS[name]
    for source in TABLES:
        if re.search(rf"\b{source}\b", sql):
            table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(sql)


def stream_view(spark: SparkSession, sf_dir: str, source: str, name: str) -> DataFrame:
    """A view over one table, read as a file stream."""
    schema = table(spark, sf_dir, source).schema
    # Written as a glob, the path may be a file as well as a folder.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{source}[.]parquet")
    stream.createOrReplaceTempView(source)
    return spark.sql(VIEWS[name])


def with_views(names: str, body: str, **more: str) -> str:
    """SQL with the named views, and further ones, as common table expressions."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names.split()] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {body}"
