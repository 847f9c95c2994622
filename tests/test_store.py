"""Manifest, key filters, merging and state of the store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from failsift.operators import index
from failsift.sources import manifest, presence, store
from failsift.sources.manifest import Entry

JOB = "job_id BIGINT, job_url STRING, created_at TIMESTAMP, job_blob STRING"


@pytest.fixture
def root(spark, tmp_path):
    store.init_store(spark, str(tmp_path))
    return str(tmp_path)


def jobs(spark, ids, url="u"):
    return spark.createDataFrame([(i, url, None, "{}") for i in ids], JOB)


def stored(spark, root, name="job"):
    return sorted(r.job_id for r in store.read_table(spark, root, name).collect())


def folders(spark, root, name="job"):
    return [e.folder for e in store.live(spark, root, name).entries]


def test_an_append_of_new_keys_opens_no_old_file(spark, root, tmp_path):
    chance = random.Random(1)
    ids = chance.sample(range(10**6), 600)  # all batches span the same range
    for n in range(3):
        assert store.append_new(jobs(spark, ids[n * 100 : n * 100 + 100]), root, "job", f"b{n}") == 100
    for old in (tmp_path / "job" / "data").rglob("*.parquet"):
        old.write_bytes(b"not a table")  # whoever opens it fails
    assert store.append_new(jobs(spark, ids[300:600]), root, "job", "b3") == 300
    with pytest.raises(Exception, match="parquet|Parquet"):
        store.append_new(jobs(spark, ids[50:51] + [10**7]), root, "job", "b4")


def test_appends_equal_a_plain_set(spark, root):
    chance, seen = random.Random(2), set()
    for n in range(6):
        ids = [chance.randrange(150) for _ in range(60)]
        added = store.append_new(jobs(spark, ids), root, "job", f"b{n}")
        assert added == len(set(ids) - seen)
        seen |= set(ids)
        if n == 3:
            assert store.tidy(spark, root, "job") == 1
    assert stored(spark, root) == sorted(seen)


def test_filters_never_miss_a_key(spark, root, tmp_path):
    rows = spark.range(5_000).selectExpr("id * 977 AS job_id", "id % 3 AS part")
    path = str(tmp_path / "keys")
    for part in range(3):
        presence.write_filter(rows.where(F.col("part") == part), ["job_id"], f"f{part}", path, presence.power_for(1_700))
    powers = {f"f{part}": presence.power_for(1_700) for part in range(3)}
    ask = lambda df: presence.folders_that_may_hold(spark, df, ["job_id"], path, powers)
    assert ask(rows) == {"f0", "f1", "f2"}
    assert ask(rows.where("part = 1")) >= {"f1"}
    alone = [ask(rows.where(f"job_id = {977 * i}")) for i in range(20)]
    assert all(f"f{i % 3}" in found for i, found in enumerate(alone))
    assert sum(len(found) for found in alone) <= 22
    assert ask(rows.limit(0)) == set()


def test_readers_that_began_before_a_merge_end_right(spark, root):
    for n in range(store.FANOUT):
        store.append_new(jobs(spark, range(10 * n, 10 * n + 10)), root, "job", f"b{n}")
    before = store.read_table(spark, root, "job")
    old = folders(spark, root)
    assert store.tidy(spark, root, "job") == 1 and store.tidy(spark, root, "job") == 0
    assert not set(old) & set(folders(spark, root)) and len(folders(spark, root)) == 1
    assert sorted(r.job_id for r in before.collect()) == list(range(40)) == stored(spark, root)
    assert sorted(r.job_id for r in store.read_batch(spark, root, "job", "b2").collect()) == list(range(20, 30))
    # a batch that runs again after it was merged is replaced, not doubled
    assert store.write_batch(jobs(spark, [21, 99]), root, "job", "b2") == 2
    assert stored(spark, root) == sorted({*range(40), 99} - set(range(20, 30)) | {21})
    assert store.append_new(jobs(spark, [5, 21, 22]), root, "job", "b9") == 1
    kept = store.append_new(jobs(spark, [1, 22]), root, "job", "b9")
    assert kept == 1 and stored(spark, root).count(22) == 1


def test_folders_grow_with_the_logarithm_of_the_batches(spark, root, monkeypatch):
    monkeypatch.setattr(store, "TIER_ROWS", 8)
    for n in range(16):
        store.write_batch(jobs(spark, [2 * n, 2 * n + 1]), root, "job", f"b{n}")
        store.tidy(spark, root, "job")
    assert stored(spark, root) == list(range(32))
    assert len(folders(spark, root)) <= 7
    entry = max(store.live(spark, root, "job").entries, key=lambda e: e.rows)
    assert entry.rows >= 16 and entry.low == 0 and entry.filter_bits


def test_old_folders_go_after_some_changes(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "KEEP_VERSIONS", 2)
    for n in range(4):
        store.write_batch(jobs(spark, [n]), root, "job", f"b{n}")
    path = str(tmp_path / "job")
    assert manifest.expire(spark, path, 2) == []
    store.tidy(spark, root, "job")
    for n in (10, 11):
        store.write_batch(jobs(spark, [n]), root, "job", f"b{n}")
    gone = manifest.expire(spark, path, 2)
    assert len(gone) == 4 and stored(spark, root) == [0, 1, 2, 3, 10, 11]
    assert not {p.name for p in (tmp_path / "job" / "data").iterdir()} & set(gone)


def test_a_draft_is_no_manifest(spark, root, tmp_path):
    store.write_batch(jobs(spark, [1]), root, "job", "b1")
    (tmp_path / "job" / "_draft-x").write_text("{")  # a writer that was lost
    (tmp_path / "job" / "data" / "000000000003").mkdir()
    assert stored(spark, root) == [1]
    store.write_batch(jobs(spark, [2]), root, "job", "b2")
    assert stored(spark, root) == [1, 2]


def test_manifest_round_trip(spark, tmp_path):
    entries = (Entry("f", ("a", "b"), 3, 1, 9, 5, ("b",)), Entry("g", ("c",), 1, "x", "y", None, (), "s", 4, True))
    manifest.publish(spark, str(tmp_path), entries, 7)
    assert manifest.load(spark, str(tmp_path)) == manifest.Manifest(7, entries)
    assert json.loads((tmp_path / "_manifest" / f"{7:012d}.json").read_text())["version"] == 7


def test_index_searches_are_equal_after_a_merge(spark, root):
    texts = {i: f"alpha w{i} " + ("beta gamma" if i % 3 else "gamma beta") for i in range(24)}
    for n in range(4):
        logs = spark.createDataFrame([(i, t) for i, t in texts.items() if i % 4 == n], "job_id BIGINT, trace STRING")
        assert store.append_logs(logs, logs, root, f"b{n}") == 6
    ask = lambda: sorted(r.job_id for r in index.jobs_with_phrase(store.read_index(spark, root), "beta gamma").collect())
    want = [i for i in texts if i % 3]
    assert ask() == want
    assert store.tidy(spark, root, "log_term") == 1 and store.tidy(spark, root, "job_log") == 1
    assert ask() == want and stored(spark, root, "job_log") == list(texts)


# State


def changes(spark, rows):
    return spark.createDataFrame([(r, u, u == 0) for r, u in rows], "root BIGINT, used BIGINT, gone BOOLEAN")


def state(spark, root, before, stream="s"):
    return {r.root: r.used for r in store.read_state(spark, root, "lineage_count", stream, before).collect()}


def bytes_of(spark, root, batch):
    """What reading the state at a batch takes."""
    from pathlib import Path
    from urllib.parse import urlparse

    return sum(Path(urlparse(f).path).stat().st_size for f in store.read_state(spark, root, "lineage_count", "s", batch).inputFiles())


def test_state_is_as_large_as_what_is_current(spark, root, monkeypatch):
    monkeypatch.setattr(store, "TIER_ROWS", 40)
    chance, want, sizes = random.Random(3), {}, []
    for n in range(50):
        store.fold_state(spark, root, "lineage_count", "s", n)
        assert n % 10 or state(spark, root, n) == {k: v for k, v in want.items() if v}
        rows = {chance.randrange(30): chance.randrange(4) for _ in range(10)}
        store.put_state(changes(spark, rows.items()), root, "lineage_count", "s", n)
        want |= rows
        sizes.append(bytes_of(spark, root, n))
    assert state(spark, root, 50) == {k: v for k, v in want.items() if v}
    assert max(sizes[40:]) <= 1.25 * max(sizes[5:15])
    assert len(folders(spark, root, "lineage_count")) <= store.MAX_CHANGES + 1


def test_state_of_a_batch_that_runs_again(spark, root, monkeypatch):
    monkeypatch.setattr(store, "MAX_CHANGES", 2)
    for n in range(5):
        for _ in range(2):  # every batch runs twice
            store.fold_state(spark, root, "lineage_count", "s", n)
            assert state(spark, root, n) == ({} if n == 0 else {1: n, 2: 5} if n < 4 else {1: 4})
            store.put_state(changes(spark, [(1, n + 1)] + ([(2, 5)] if n == 0 else [(2, 0)] if n == 3 else [])), root, "lineage_count", "s", n)
    store.put_state(changes(spark, [(1, 7)]), root, "lineage_count", "other", 0)
    assert state(spark, root, 9) == {1: 5} and state(spark, root, 9, "other") == {1: 7}
