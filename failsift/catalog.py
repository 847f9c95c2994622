"""The catalog of known signatures of failures that a retry may cure.

An entry is a code, a message and a predicate over (failure reason, log). The
predicates are plain Spark columns, so a user can add entries of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from failsift.schemas import REASON_RUNNER, REASON_STUCK

Predicate = Callable[[Column, Column], Column]

# Patterns treat LF alone as the end of a line, as CI logs carry bare CR inside
# section markers: ^ and $ match at LF, and the dot stops only there.
LINE_FLAGS = "(?md)"


@dataclass(frozen=True)
class Check:
    code: str
    message: str
    test: Predicate
    kind: str
    active: bool = True


def has_reason(code: str, message: str, value: str) -> Check:
    return Check(code, message, lambda reason, log: reason.eqNullSafe(F.lit(value)), "reason")


def has_text(code: str, message: str, *needles: str, active: bool = True) -> Check:
    """Any of the needles occurs in the log."""

    def test(reason: Column, log: Column) -> Column:
        return reduce(lambda a, b: a | b, [log.contains(n) for n in needles])

    return Check(code, message, test, "literal", active)


def has_pattern(code: str, message: str, pattern: str, needles: Iterable[str | tuple[str, ...]] = ()) -> Check:
    """The pattern occurs in the log.

    ``needles`` are texts every match must contain, a tuple being any of its
    texts. They are tested first, as a substring test is far cheaper than
    running the pattern over a whole log.
    """

    def guard(log: Column, needle: str | tuple[str, ...]) -> Column:
        texts = (needle,) if isinstance(needle, str) else needle
        return reduce(lambda a, b: a | b, [log.contains(t) for t in texts])

    def test(reason: Column, log: Column) -> Column:
        guards = [guard(log, n) for n in needles]
        return reduce(lambda a, b: a & b, [*guards, log.rlike(LINE_FLAGS + pattern)])

    return Check(code, message, test, "pattern")


# Codes, messages and texts to look for. "[0-9]+" in
# cannot_allocate spells out the digits the signature is meant to match.
CHECKS: tuple[Check, ...] = (
    has_reason("job_timeout", "job timeout", REASON_STUCK),
    has_reason("runner_system", "runner failure", REASON_RUNNER),
    has_text(
        "docker",
        "docker failure",
        "Cannot connect to the Docker daemon at unix:///var/run/docker.sock",
    ),
    has_text(
        "pull_image",
        "image pull failure",
        'failed to pull image "registry.gitlab.haskell.org',
        active=False,
    ),
    has_text("connect_gitlab", "GitLab connection failure", "Failed to connect to gitlab.haskell.org"),
    has_text("no_space", "exhausted disk", "No space left on device", active=False),
    has_pattern(
        "signal_9",
        "received signal 9",
        "failed due to signal 9 .Killed",
        ["failed due to signal 9 "],
    ),
    has_pattern(
        "cannot_allocate",
        "could not allocate memory",
        "osCommitMemory: VirtualAlloc MEM_COMMIT failed|out of memory allocating [0-9]+ bytes",
        [("osCommitMemory: VirtualAlloc MEM_COMMIT failed", "out of memory allocating ")],
    ),
    has_text("MoveFileEx", "MoveFileEx-related failure", "MoveFileEx"),
    has_pattern(
        "submodule_clone",
        "Submodule clone failure",
        "Failed to clone '.*' a second time, aborting",
        ["Failed to clone '", "' a second time, aborting"],
    ),
    has_text(
        "ghc-pkg_died",
        "ghc-pkg or hadrian failure",
        "ghc-pkg dump failed: dieVerbatim: user error",
    ),
    has_text(
        "nix_T7273",
        "Nix#7273 failure",
        "cannot link '/nix/store/.tmp-link",
        "error: clearing flags of path '/nix/store",
    ),
    has_pattern(
        "cabal_hadrian_segfault",
        '"cabal exec hadrian" segfault',
        "Segmentation fault.*CABAL.*new-exec.*hadrian",
        ["Segmentation fault", "CABAL", "new-exec", "hadrian"],
    ),
    has_text(
        "runner_process_terminated",
        "runner terminated",
        "ERROR: Job failed (system failure): aborted: terminated",
    ),
    has_pattern(
        "ghc-config_file_conflict",
        "ghc-config file conflict",
        "posix_spawnp: resource busy",
        ["posix_spawnp: resource busy"],
    ),
    has_pattern(
        "code_-11",
        "error code: -11",
        "Command failed with error code: -11",
        ["Command failed with error code: -11"],
    ),
    has_pattern(
        "ulimit",
        "ulimit: Invalid argument",
        "ulimit: virtual memory: cannot modify limit: Invalid argument",
        ["ulimit: virtual memory: cannot modify limit: Invalid argument"],
    ),
    has_text("repo_clone", "error cloning fresh repository", "fresh repository.\x1b[0;m\nerror"),
    has_text("perf_note_fetch", "error fetch perf notes", "refs/notes/perf:refs/notes/perf\nerror:"),
    has_pattern("sigquit", "death by SIGQUIT", "^SIGQUIT: quit", ["SIGQUIT: quit"]),
    has_text("stack_T6388", "stack #6388", "Error: [S-922]"),
    has_text(
        "hadrian_locked_file",
        "Hadrian exception: locked file",
        "withFile: resource busy (file is locked)",
        "copyFileToHandle:openFile: resource busy (file is locked)",
    ),
    has_text("code_-4", "error code: -4", "Command failed with error code: -4"),
    has_text(
        "wasm_ghc-pkg",
        "wasm32-wasi-ghc-pkg recache",
        "wasm32-wasi-ghc-pkg: createProcess: exec: invalid argument (Bad file descriptor)",
    ),
)


def active_checks(kind: str | None = None) -> list[Check]:
    return [c for c in CHECKS if c.active and kind in (None, c.kind)]
