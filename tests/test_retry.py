import random
from datetime import datetime, timedelta

import pytest

from failsift.operators import retry

START = datetime(2024, 1, 1)


def simulate(rows):
    """The count of every lineage, command by command."""
    counts, out = {}, {}
    for root, ts, seq, cmd, accepted in sorted(rows, key=lambda r: (r[1], r[2])):
        used = counts.pop(root, 0)
        if cmd == "clear":
            continue
        if used >= 10:
            out[seq] = ("exceeded", None)
        elif not accepted:
            out[seq] = ("request_failed", None)
        else:
            counts[root] = used + 1
            out[seq] = ("retry", 10 - used - 1)
    return out


def random_commands(seed, n, roots, clears=0.05, failures=0.05, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        root = 0 if rng.random() < hot else rng.randrange(roots)
        ts = START + timedelta(minutes=rng.randrange(n // 2))
        cmd = "clear" if rng.random() < clears else "retry"
        rows.append((root, ts, seq, cmd, rng.random() >= failures))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "root BIGINT, ts TIMESTAMP, seq BIGINT, cmd STRING, accepted BOOLEAN")


def decisions(df):
    return {r.seq: (r.decision, r.retries_remaining) for r in df.collect()}


@pytest.mark.parametrize("chunks", [1, 3, 16, 60])
@pytest.mark.parametrize("hot,clears", [(0.0, 0.1), (0.4, 0.02), (1.0, 0.0), (1.0, 0.01)])
def test_budget_equals_simulation(spark, chunks, hot, clears):
    rows = random_commands(chunks, 600, 5, clears=clears, failures=clears, hot=hot)
    assert decisions(retry.retry_budget(frame(spark, rows), chunks)) == simulate(rows)


def test_budget_of_one_lineage(spark):
    rows = [(1, START + timedelta(hours=i), i, "retry", True) for i in range(13)]
    got = decisions(retry.retry_budget(frame(spark, rows).drop("accepted")))
    assert [got[i] for i in range(10)] == [("retry", 9 - i) for i in range(10)]
    assert [got[i] for i in range(10, 13)] == [("exceeded", None), ("retry", 9), ("retry", 8)]


def test_equal_times_are_ordered_by_sequence(spark):
    rows = [(1, START, i, "clear" if i == 4 else "retry", True) for i in range(8)]
    assert decisions(retry.retry_budget(frame(spark, rows), 4)) == simulate(rows)


def test_a_hot_lineage_is_spread_over_tasks(spark):
    rows = random_commands(1, 2000, 5, clears=0.0, hot=1.0)
    df = retry.retry_budget(frame(spark, rows), 16)
    sizes = [r["count"] for r in df.groupBy(retry.F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 1000
    assert decisions(df) == simulate(rows)


def links(spark, rows):
    return spark.createDataFrame(rows, "job_id BIGINT, new_job_id BIGINT")


def lineage(df):
    return {r.job_id: (r.root, r.depth) for r in df.collect()}


def test_lineage_of_chains_and_trees(spark):
    chain = [(i, i + 1) for i in range(100, 150)]
    star = [(1, 2 + i) for i in range(20)]
    deep = [(5, 60), (60, 61)]
    want = {i: (100, i - 100) for i in range(100, 151)}
    want |= {1: (1, 0)} | {2 + i: (1, 1) for i in range(20)} | {60: (1, 2), 61: (1, 3)}
    assert lineage(retry.retry_lineage(links(spark, chain + star + deep + chain))) == want


def test_lineage_of_no_links(spark):
    assert lineage(retry.retry_lineage(links(spark, []))) == {}


def test_links_no_lineage_can_follow_are_named(spark):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (10, 11), (9, 11), (11, 12)]
    assert lineage(retry.retry_lineage(links(spark, rows))) == {9: (9, 0), 10: (10, 0), 11: (9, 1), 12: (9, 2)}
    lost = {tuple(r) for r in retry.lost_links(links(spark, rows)).collect()}
    assert lost == {(1, 2), (2, 3), (3, 1), (3, 4), (10, 11)}


def test_retry_commands(spark):
    jobs = spark.createDataFrame(
        [(1, 9, "failed", START), (2, 9, "failed", START), (3, 9, "success", START)],
        "job_id BIGINT, project_id BIGINT, build_status STRING, finished_at TIMESTAMP",
    )
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a")], "job_id BIGINT, type STRING")
    got = {r.job_id: r.cmd for r in retry.retry_commands(jobs, hits).collect()}
    assert got == {1: "retry", 2: "clear", 3: "clear"}


def test_bookkeeping_equals_the_map_of_job_counts(spark):
    rng = random.Random(11)
    rows, pairs, job, want, counts = [], [], 0, {}, {}
    for chain in range(12):
        for step in range(rng.choice([3, 11, 12, 25])):
            ts = START + timedelta(hours=step, minutes=chain)
            cmd = "clear" if rng.random() < 0.05 else "retry"
            rows.append((job, ts, cmd))
            linked = rng.random() > 0.03
            if linked:
                pairs.append((job, job + 1))
            used = counts.pop(job, 0)
            if cmd == "retry":
                if used >= 10:
                    want[job] = ("exceeded", None, None)
                elif linked:
                    counts[job + 1] = used + 1
                    want[job] = ("retry", job + 1, 9 - used)
                else:
                    want[job] = ("request_failed", None, None)
            job += 1
        job += 5
    commands = spark.createDataFrame(rows, "job_id BIGINT, ts TIMESTAMP, cmd STRING")
    got = retry.bookkeeping(commands, links(spark, pairs), chunks=7).collect()
    assert {r.job_id: (r.decision, r.new_job_id, r.retries_remaining) for r in got} == want
    first = next(r for r in got if r.decision == "retry")
    assert first.note == (
        f"{first.job_id}:finished:failed:retrying:continued by {first.new_job_id}"
        f", left {first.retries_remaining}"
    )
