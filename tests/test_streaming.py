from pyspark.sql import functions as F

from capweave.operators import store
from capweave.operators.scratch import materialize, scratch_path
from capweave.plans import catalogue as C
from capweave.sources import sample_site as S
from capweave.streaming import jobs


def arrivals(spark, captures, files=6):
    path = scratch_path(spark, "arrivals")
    captures.repartition(files, "capture_id").write.parquet(path)
    return path, jobs.read_captures(spark, path, captures.schema, 2)


def test_repeated_batch_changes_nothing(spark):
    out = scratch_path(spark, "store")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "surt string, n int")
    jobs._write_batch(rows, out, "a", 0)
    jobs._write_batch(rows, out, "a", 0)
    assert jobs.read_store(spark, out, "surt string, n int, run string, batch long").count() == 2


def test_store_goes_on_after_a_restart(spark, sf_dir):
    captures = materialize(S.captures(spark, sf_dir), "captures")
    first, second = captures.filter("hops < 2"), captures.filter("hops >= 2")
    path, stream = arrivals(spark, first)
    out, state = scratch_path(spark, "store"), scratch_path(spark, "state")
    jobs.store_latest(stream, out, state).awaitTermination()
    second.repartition(4).write.mode("append").parquet(path)
    jobs.store_latest(jobs.read_captures(spark, path, captures.schema, 2), out, state).awaitTermination()
    got = {(r["surt"], r["capture_id"]) for r in jobs.read_latest(spark, out, captures.schema).collect()}
    want = {(r["surt"], r["capture_id"]) for r in store.latest(captures).collect()}
    assert got == want


def test_seen_set_equals_distinct_keys(spark, sf_dir):
    captures = S.captures(spark, sf_dir).select("capture_id", "surt")
    _, stream = arrivals(spark, captures)
    out = scratch_path(spark, "seen")
    jobs.store_unseen(stream, out, scratch_path(spark, "state")).awaitTermination()
    seen = [r["surt"] for r in jobs.read_store(spark, out, "surt string, run string, batch long").collect()]
    assert len(seen) == len(set(seen)) and set(seen) == {r["surt"] for r in captures.distinct().collect()}


def test_another_checkpoint_keeps_what_the_store_holds(spark):
    out = scratch_path(spark, "seen")
    for k, keys in enumerate((["a", "b"], ["b", "c"])):
        rows = spark.createDataFrame([(f"{k}{x}", x) for x in keys], "capture_id string, surt string")
        _, stream = arrivals(spark, rows, 1)
        jobs.store_unseen(stream, out, scratch_path(spark, "state")).awaitTermination()
    seen = sorted(r["surt"] for r in jobs.read_store(spark, out, "surt string, run string, batch long").collect())
    assert seen == ["a", "b", "c"]


def test_rates_equal_counts(spark, sf_dir):
    captures = S.captures(spark, sf_dir).select("capture_id", "fetched_at")
    _, stream = arrivals(spark, captures)
    out = scratch_path(spark, "rates")
    jobs.store_rates(stream, "hour", 3, "31 days", out, scratch_path(spark, "state")).awaitTermination()
    got = {(r["period_start"], r["captures"], r["over_quota"], r["over_burst"]) for r in jobs.read_rates(spark, out).collect()}
    hours = captures.groupBy(F.date_format(F.date_trunc("hour", "fetched_at"), "yyyy-MM-dd HH:mm:ss")).count().collect()
    assert got == {(h, n, n > 3, n > 6) for h, n in hours}


def test_the_rate_query_allows_for_the_whole_span_of_time(spark, sf_dir):
    from capweave.plans import catalogue

    late = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS fetched_at UNION ALL SELECT timestamp_ntz'2024-06-01 00:00:00'")
    assert catalogue._span(late) == f"{152 * 86_400 + 1} seconds"
    assert catalogue._span(late.limit(0)) == "0 seconds"
    assert catalogue.stream_rate(spark, sf_dir).count() > 0


def test_arrivals_stay_where_they_are(spark, sf_dir):
    captures = S.captures(spark, sf_dir).select("capture_id", "surt")
    for parts, most in ((1, 3), (24, 8)):  # eight files at least; a third of the files at a time, so no few tasks read all
        seen = []
        stream = C._arrivals(spark, sf_dir, captures.repartition(parts))
        run = stream.select("capture_id", F.input_file_name().alias("file")).writeStream.trigger(availableNow=True)
        run = run.foreachBatch(lambda b, n: seen.append((b.count(), b.select("file").distinct().count())))
        run.option("checkpointLocation", scratch_path(spark, "state")).start().awaitTermination()
        assert len(seen) == 3 and sum(n for n, _ in seen) == captures.count() and max(f for _, f in seen) == most
