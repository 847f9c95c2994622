import pytest
from pyspark.sql import functions as F

from failsift.catalog import CHECKS, Check, active_checks, has_text
from failsift.operators.classify import classify, label_gaps, retry_candidates, unclassified
from failsift.schemas import STORED_LABELS

ESC = "\x1b"

# One log per check that must match, and one close to it that must not.
# Texts the signatures must tell apart.
CASES = {
    "docker": (
        "ERROR: Cannot connect to the Docker daemon at unix:///var/run/docker.sock. Is it running?",
        "Cannot connect to the Docker daemon at tcp://var/run/docker.sock",
    ),
    "connect_gitlab": (
        "fatal: Failed to connect to gitlab.haskell.org port 443",
        "failed to connect to gitlab.haskell.org",
    ),
    "signal_9": ("builder failed due to signal 9 (Killed); last lines", "failed due to signal 9 \nKilled"),
    "cannot_allocate": ("x: out of memory allocating 1048576 bytes", "out of memory allocating many bytes"),
    "MoveFileEx": ("rename: MoveFileEx \"a\" \"b\"", "MoveFileex"),
    "submodule_clone": (
        "Failed to clone 'libraries/text' a second time, aborting",
        "Failed to clone 'libraries/\ntext' a second time, aborting",
    ),
    "ghc-pkg_died": ("ghc-pkg dump failed: dieVerbatim: user error (x)", "ghc-pkg dump failed: dieVerbatim"),
    "nix_T7273": ("error: clearing flags of path '/nix/store/abc'", "error: clearing flags of path /nix/store"),
    "cabal_hadrian_segfault": (
        "Segmentation fault (core dumped) \"$CABAL\" \r new-exec -- hadrian",
        "Segmentation fault\n$CABAL new-exec hadrian",
    ),
    "runner_process_terminated": (
        "ERROR: Job failed (system failure): aborted: terminated",
        "ERROR: Job failed: aborted: terminated",
    ),
    "ghc-config_file_conflict": ("runInteractiveProcess: posix_spawnp: resource busy (x)", "posix_spawnp: busy"),
    "code_-11": ("Command failed with error code: -11", "Command failed with error code: 11"),
    "ulimit": (
        "ulimit: virtual memory: cannot modify limit: Invalid argument",
        "ulimit: virtual memory: cannot modify limit",
    ),
    "repo_clone": (
        f"Created fresh repository.{ESC}[0;m\nerror: RPC failed",
        f"Created fresh repository.{ESC}[0;m\r\nerror: RPC failed",
    ),
    "perf_note_fetch": ("refs/notes/perf:refs/notes/perf\nerror: x", "refs/notes/perf:refs/notes/perf error: x"),
    "sigquit": ("ok\nSIGQUIT: quit\nPC=0x", "section\rSIGQUIT: quit"),
    "stack_T6388": ("Error: [S-922]\nno", "Error: S-922"),
    "hadrian_locked_file": (
        "copyFileToHandle:openFile: resource busy (file is locked)",
        "openFile: resource busy (file is locked)",
    ),
    "code_-4": ("Command failed with error code: -4", "Command failed with error code: 4"),
    "wasm_ghc-pkg": (
        "wasm32-wasi-ghc-pkg: createProcess: exec: invalid argument (Bad file descriptor)",
        "ghc-pkg: createProcess: exec: invalid argument (Bad file descriptor)",
    ),
}


def jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id BIGINT, failure_reason STRING, trace STRING")


def found(df):
    return {(r.job_id, r.type) for r in df.collect()}


def test_every_log_check_has_a_case():
    assert set(CASES) == {c.code for c in active_checks() if c.kind != "reason"}
    assert len(active_checks()) == 22
    assert {c.code for c in CHECKS if not c.active} == {"pull_image", "no_space"}


def test_positive_and_negative_logs(spark):
    rows = []
    for i, (code, (good, bad)) in enumerate(sorted(CASES.items())):
        rows += [(2 * i, None, good), (2 * i + 1, None, bad)]
    want = {(2 * i, code) for i, code in enumerate(sorted(CASES))}
    assert found(classify(jobs(spark, rows))) == want


def test_a_log_with_sections_and_colours_yields_one_code(spark):
    log = (
        f"{ESC}[1mwaiting for a machine{ESC}[0m\nphase:fetch\r{ESC}[2K{ESC}[36mcopying sources{ESC}[0m\n"
        f"{ESC}[36mdone{ESC}[0m\nthe step failed due to signal 9 (Killed); see above\n"
    )
    got = classify(jobs(spark, [(1, None, log)])).collect()
    assert [(r.type, r.message) for r in got] == [("signal_9", "received signal 9")]


def test_reasons(spark):
    rows = [
        (1, "stuck_or_timeout_failure", ""),
        (2, "runner_system_failure", None),
        (3, "job_execution_timeout", ""),
        (4, "script_failure", ""),
        (5, None, None),
    ]
    df = jobs(spark, rows)
    assert found(classify(df)) == {(1, "job_timeout"), (2, "runner_system")}
    assert {r.job_id for r in unclassified(df).collect()} == {3, 4, 5}


def test_all_hits_are_kept_and_columns_may_be_absent(spark):
    df = jobs(spark, [(1, "runner_system_failure", "MoveFileEx\nError: [S-922]")])
    assert found(classify(df)) == {(1, "runner_system"), (1, "MoveFileEx"), (1, "stack_T6388")}
    assert found(classify(df.drop("trace"))) == {(1, "runner_system")}
    assert found(classify(df.drop("failure_reason"))) == {(1, "MoveFileEx"), (1, "stack_T6388")}


def test_own_checks_and_set_semantics(spark):
    df = jobs(spark, [(1, None, "disk full"), (2, "x", "disk ok")])
    both = Check("odd", "odd job", lambda reason, log: reason.isNotNull() & log.contains("disk"), "own")
    same = [has_text("disk", "disk", "full"), has_text("disk", "disk", "disk")]
    assert found(classify(df, [both])) == {(2, "odd")}
    got = classify(df, same).collect()
    assert sorted((r.job_id, r.type) for r in got) == [(1, "disk"), (2, "disk")]


def test_retry_candidates_and_label_gaps(spark):
    failed = jobs(spark, [(1, None, "MoveFileEx"), (2, None, "SIGQUIT: quit"), (3, None, "")])
    hits = classify(failed)
    got = {r.job_id: r.retry for r in retry_candidates(failed.select("job_id"), hits).collect()}
    assert got == {1: True, 2: True, 3: False}
    gaps = {r.type: r.failures for r in label_gaps(hits).collect()}
    assert gaps == {"sigquit": 1}


def test_label_sets():
    emitted = {c.code for c in active_checks()}
    assert emitted - set(STORED_LABELS) == {"sigquit", "hadrian_locked_file", "code_-4", "wasm_ghc-pkg"}
    assert set(STORED_LABELS) - emitted == {"type", "no_space", "T16916", "pull_image"}


@pytest.mark.parametrize("check", [c for c in active_checks() if c.kind == "pattern"], ids=lambda c: c.code)
def test_needles_do_not_change_a_pattern(spark, check):
    texts = [t for pair in CASES.values() for t in pair]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    hit = {r.t for r in df.where(check.test(F.lit(None), F.col("t"))).collect()}
    assert hit == {CASES[check.code][0]}
