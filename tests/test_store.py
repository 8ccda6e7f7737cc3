from datetime import datetime

import pytest
from pyspark.sql import functions as F

from capweave.operators import skew, store
from capweave.operators.ordering import ordered, with_rank, with_running_start
from capweave.operators.skew import heavy_keys, skew_join
from capweave.operators.scratch import scratch_path
from capweave.plans.session import ship_package
from capweave.sources import store_files

SCHEMA = "capture_id string, surt string, fetched_at timestamp_ntz, body binary, body_digest string"


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


def captures(spark, rows):
    return spark.createDataFrame([(i, k, at(m), b, b.decode()) for i, k, m, b in rows], SCHEMA)


def ids(df):
    return sorted(r["capture_id"] for r in df.collect())


def test_latest_settles_ties_by_id(spark):
    df = captures(spark, [("1", "a", 1, b"x"), ("2", "a", 3, b"y"), ("3", "a", 3, b"z"), ("4", "b", 0, b"")])
    assert ids(store.latest(df)) == ["3", "4"]


def test_append_new_keeps_stored_keys(spark):
    old = captures(spark, [("1", "a", 1, b"x")])
    new = captures(spark, [("2", "a", 9, b"y"), ("3", "b", 1, b"z"), ("4", "b", 2, b"z")])
    assert ids(store.append_new(old, new)) == ["4"]


def test_body_limit_is_strict(spark):
    df = captures(spark, [("1", "a", 1, b"1234"), ("2", "b", 1, b"12345")])
    kept, failed = store.split_by_size(df, 4)
    assert ids(kept) == ["1"] and ids(failed) == ["2"]
    assert failed.first()["error"] == "BodyTooLarge"
    kept, failed = store.split_by_size(df, None)
    assert ids(kept) == ["1", "2"] and ids(failed) == []


def test_bodies_by_content_with_a_hot_address(spark):
    rows = [(f"{i:03}", f"k{i}", 0, b"" if i % 3 else b"body%d" % i) for i in range(90)]
    df = captures(spark, rows)
    bodies = store.distinct_bodies(df)
    assert bodies.count() == 31
    found = store.attach_bodies(df.drop("body"), bodies, heavy_rows=20).collect()
    assert sorted((r["capture_id"], bytes(r["body"])) for r in found) == sorted((i, b) for i, _, _, b in rows)
    dup = store.duplicate_bodies(df).collect()
    assert [(r["captures"], r["keys"]) for r in dup] == [(60, 60)]


def test_versions_with_a_hot_key(spark):
    rows = [(f"{i:03}", "hot" if i % 2 else f"k{i}", i % 60, b"") for i in range(120)]
    got = {(r["capture_id"], r["version"]) for r in store.versions(captures(spark, rows)).collect()}
    by_key = {}
    for i, k, m, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_key.setdefault(k, []).append(i)
    assert got == {(i, n) for ids_ in by_key.values() for n, i in enumerate(ids_, 1)}


def test_skew_join_equals_plain_join(spark):
    left = spark.range(1000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3)], "k string, v int")
    assert [tuple(r) for r in heavy_keys(left, "k", 100).collect()] == [("hot", 4)] and heavy_keys(left, "k", 10_000) is None
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = skew_join(left, right, "k", "n", how, heavy_rows=100)
        assert sorted(map(tuple, salted.select("n").collect())) == sorted(
            map(tuple, left.join(right, "k", how).select("n").collect())
        )


@pytest.mark.parametrize("limit", [0, 100])
def test_key_join_with_short_and_long_lists(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", limit)
    left = spark.createDataFrame([(i, "hot" if i % 2 else str(i)) for i in range(50)], "n int, k string")
    keys = spark.createDataFrame([("hot",), ("hot",), ("4",)], "k string")
    kept = sorted(r["n"] for r in skew.key_join(left, keys, "k", "n", "left_semi").collect())
    rest = sorted(r["n"] for r in skew.key_join(left, keys, "k", "n", "left_anti").collect())
    assert kept == sorted([4, *range(1, 50, 2)]) and rest == sorted(set(range(50)) - set(kept))


def test_written_store_keeps_or_clears(spark):
    root = scratch_path(spark, "store")
    base = {c: F.lit(None).cast("string") for c in store.METADATA_COLUMNS if c not in ("capture_id", "surt", "fetched_at")}
    old = captures(spark, [("1", "a", 1, b"x"), ("2", "b", 1, b"y")]).withColumns(base)
    new = captures(spark, [("3", "b", 5, b"z"), ("4", "c", 1, b"x"), ("5", "d", 1, b"w")]).withColumns(base)

    def held():
        rows = store.attach_bodies(store_files.read_index(spark, root), store_files.read_bodies(spark, root))
        return sorted((r["surt"], r["capture_id"], bytes(r["body"])) for r in rows.collect())

    store_files.write_store(old, root)
    assert held() == [("a", "1", b"x"), ("b", "2", b"y")]
    store_files.append_store(new, root)
    assert held() == [("a", "1", b"x"), ("b", "2", b"y"), ("c", "4", b"x"), ("d", "5", b"w")]
    assert store_files.read_bodies(spark, root).count() == 3
    store_files.write_store(new, root)
    assert [r[:2] for r in held()] == [("b", "3"), ("c", "4"), ("d", "5")]


def test_rank_and_running_total_over_parts(spark):
    ship_package(spark)
    rows = [("hot" if i % 3 else f"k{i:04}", i, i % 17) for i in range(3000)]
    placed = ordered(spark.createDataFrame(rows, "k string, i long, size long"), ["k", "i"], parts=6)
    assert placed.select("part").distinct().count() == 6
    got = sorted(
        (r["rank"], r["k"], r["i"], r["start"]) for r in with_running_start(with_rank(placed), "size").collect()
    )
    start = 0
    for rank, (k, i, size) in enumerate(sorted(rows)):
        assert got[rank] == (rank, k, i, start)
        start += size


def test_seeds(spark):
    raw = spark.createDataFrame([(" http://A.com ",), ("nope",), ("https://b.com/x#y",)], "raw_url string")
    got = sorted((r["surt"], r["url"], r["hops"]) for r in store.seed_urls(raw).collect())
    assert got == [("com,a)/", "http://a.com/", 0), ("com,b)/x", "https://b.com/x#y", 0)]
