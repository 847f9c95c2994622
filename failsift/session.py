"""Session helpers: defaults for local work and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession


# A scan decodes this many rows at a time. Logs of a megabyte and more would make the
# default of 4096 rows outgrow an executor.
ROWS_PER_BATCH = 256


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "failsift") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.parquet.columnarReaderBatchSize", str(ROWS_PER_BATCH))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only on a local master with the setting unset;
    on a cluster a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="failsift-"))
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored rows.

    Later stages then see the same rows in the same partitions even when an
    executor is lost and its tasks run again.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settle_and_measure(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict[str, object]]:
    """Like :func:`settle`, with aggregates that are taken while the rows are written."""
    seen = Observation()
    stored = settle(df.observe(seen, *measures))
    return stored, seen.get


def at_once(spark: SparkSession, *steps: Callable[[], object]) -> list[object]:
    """Run steps that do not depend on each other side by side, so that the jobs of one fill
    what those of another leave idle; gives their results, or raises the first error."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]
