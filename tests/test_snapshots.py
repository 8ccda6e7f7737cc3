"""The versioned store: snapshots, seeds replaced, deletes merged on read, isolation, conflicts, vacuum."""

import tempfile

import pytest
from pyspark.sql import functions as F

from capweave.sources import sample_site as S
from capweave.sources import snapshots


@pytest.fixture(scope="module")
def captures(spark, sf_dir):
    return S.captures(spark, sf_dir).cache()


def keys(df):
    return {(r.surt, r.capture_id) for r in df.select("surt", "capture_id").collect()}


def latest_rows(df):
    rows = {}
    for r in df.select("surt", "capture_id", "fetched_at").collect():
        if r.surt not in rows or (r.fetched_at, r.capture_id) > rows[r.surt][1:]:
            rows[r.surt] = (r.capture_id, r.fetched_at, r.capture_id)
    return {(s, v[0]) for s, v in rows.items()}


def test_versions_seeds_and_deletes(spark, captures):
    root = tempfile.mkdtemp(prefix="store-test-")
    old = captures.filter("hops <= 1")
    v1 = snapshots.write(old, root)
    first = latest_rows(old)
    assert keys(snapshots.read_index(spark, root, v1)) == first
    reader = snapshots.read_index(spark, root, v1)  # resolved before the next commits
    seeds = spark.createDataFrame(sorted({(s,) for s, _ in first})[:5], "surt string")
    seed_keys = {r.surt for r in seeds.collect()}
    v2 = snapshots.write(captures, root, mode="no_clobber", seeds=seeds)
    kept = {(s, c) for s, c in first if s not in seed_keys}
    everything = latest_rows(captures)
    want2 = kept | {(s, c) for s, c in everything if s not in {k for k, _ in kept}}
    assert keys(snapshots.read_index(spark, root, v2)) == want2
    doomed = spark.createDataFrame([(s,) for s, _ in sorted(want2)[:7]], "surt string")
    v3 = snapshots.delete(spark, root, doomed)
    gone = {r.surt for r in doomed.collect()}
    assert keys(snapshots.read_index(spark, root)) == {(s, c) for s, c in want2 if s not in gone}
    assert keys(reader) == first  # an old reader is undisturbed
    assert snapshots.versions(spark, root) == [v1, v2, v3] == [1, 2, 3]
    # a key deleted at 3 may be stored again at 4
    v4 = snapshots.write(captures, root, mode="no_clobber")
    again = keys(snapshots.read_index(spark, root, v4))
    assert {s for s, _ in again} >= gone & {s for s, _ in everything}


def test_overwrite_clears_and_bodies_follow(spark, captures):
    root = tempfile.mkdtemp(prefix="store-test-")
    snapshots.write(captures.filter("hops = 0"), root)
    v2 = snapshots.write(captures.filter("hops > 0"), root)
    assert keys(snapshots.read_index(spark, root, v2)) == latest_rows(captures.filter("hops > 0"))
    index, bodies = snapshots.read_index(spark, root, v2), snapshots.read_bodies(spark, root, v2)
    assert index.join(bodies, "body_digest", "left_anti").count() == 0


def test_commit_conflict_and_crawl_info(spark, captures):
    root = tempfile.mkdtemp(prefix="store-test-")
    crawl = spark.createDataFrame([("{}", "com,example)/")], "config string, entry_point string")
    snapshots.write(captures.filter("hops = 0"), root, crawl=crawl)
    parent = snapshots.snapshot(spark, root, 1)  # two writers start from version 1
    snapshots.delete(spark, root, crawl.select(F.col("entry_point").alias("surt")))
    with pytest.raises(snapshots.CommitConflict):
        snapshots._commit(spark, root, parent, {}, False)
    assert snapshots.versions(spark, root) == [1, 2]
    assert [r.entry_point for r in snapshots.read_crawl_info(spark, root, 1).collect()] == ["com,example)/"]


def test_vacuum_keeps_what_the_last_snapshot_reads(spark, captures):
    root = tempfile.mkdtemp(prefix="store-test-")
    snapshots.write(captures.filter("hops = 0"), root)
    v2 = snapshots.write(captures.filter("hops > 0"), root)
    want = keys(snapshots.read_index(spark, root, v2))
    gone = snapshots.vacuum(spark, root, keep=1)
    assert gone and snapshots.versions(spark, root) == [v2]
    assert keys(snapshots.read_index(spark, root)) == want


def test_empty_store(spark, captures):
    root = tempfile.mkdtemp(prefix="store-test-")
    assert snapshots.versions(spark, root) == [] and snapshots.snapshot(spark, root) is None
    v1 = snapshots.write(captures.filter("hops < 0"), root)
    assert snapshots.read_index(spark, root, v1).count() == 0
