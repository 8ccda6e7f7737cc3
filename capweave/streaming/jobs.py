"""Streaming forms of link discovery, the seen check, the store and the rate audit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capweave.operators.audit import fetch_rate
from capweave.operators.extract import Extractors, extract_links, resolve_links, within_hops
from capweave.operators.rules import Rule
from capweave.operators.scratch import materialize
from capweave.operators.store import latest


def read_captures(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    """Captures as files arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def discover_links(
    captures: DataFrame, rules: Sequence[Rule], max_hops: int, extractors: Extractors | None = None
) -> DataFrame:
    """Resolved links within the hop limit.  Stateless, the same plan as in batch."""
    return within_hops(resolve_links(extract_links(captures, rules, extractors)), max_hops)


def write_stream(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the input present at the start is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_seen(captures: DataFrame) -> DataFrame:
    """First capture of each key in a bounded replay; state grows with the keys."""
    return captures.select("surt").dropDuplicates(["surt"])


def _each_batch(
    df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _batches(path: str, spark: SparkSession, schema) -> DataFrame:
    """Rows written by batches of all runs."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _run_id(checkpoint: str) -> str:
    """Names the batches of one checkpoint: another checkpoint counts its batches from 0 again."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _write_batch(rows: DataFrame, path: str, run: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/run=r{run}/batch={number}")


_SEEN_SCHEMA = "surt string, run string, batch long"


def store_unseen(captures: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keep one key row per unseen key.  The seen set is a table, not state, so
    it does not grow in executor memory.

    What the store held before the stream began, from other checkpoints too, counts as seen.
    """
    run = _run_id(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.select("surt").distinct()
        spark = batch.sparkSession
        if exists(spark, store):
            known = _batches(store, spark, _SEEN_SCHEMA)
            # A batch that is repeated sees what its first run saw.
            known = known.filter((F.col("run") != f"r{run}") | (F.col("batch") < number))
            fresh = materialize(fresh.join(known.select("surt"), "surt", "left_anti"), "unseen")
        _write_batch(fresh, store, run, number)

    return _each_batch(captures.select("surt"), checkpoint, write)


def store_latest(captures: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's current captures to the store.

    Writing a batch costs the batch, not the store; :func:`read_latest` settles
    which batch holds the current capture of a key.
    """
    run = _run_id(checkpoint)
    return _each_batch(captures, checkpoint, lambda batch, number: _write_batch(latest(batch), store, run, number))


def read_store(spark: SparkSession, store: str, schema) -> DataFrame:
    return _batches(store, spark, schema)


def read_latest(spark: SparkSession, store: str, schema) -> DataFrame:
    return latest(read_store(spark, store, schema))


_RATE_SCHEMA = "period_start string, captures long, over_quota boolean, over_burst boolean, run string, batch long"


def store_rates(
    captures: DataFrame, per: str, limit: int, lateness: str, store: str, checkpoint: str
) -> StreamingQuery:
    """Write the periods each batch changed.  State for a period is dropped once
    the watermark passes it."""
    run = _run_id(checkpoint)
    timed = captures.withColumn("at", F.col("fetched_at").cast("timestamp")).withWatermark("at", lateness)
    return (
        fetch_rate(timed, per, limit, F.col("at"))
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: _write_batch(batch, store, run, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_rates(spark: SparkSession, store: str) -> DataFrame:
    """Final count of each period; counts only grow from batch to batch."""
    rows = _batches(store, spark, _RATE_SCHEMA)
    values = ("captures", "over_quota", "over_burst")
    return rows.groupBy("period_start").agg(*[F.max(v).alias(v) for v in values])
