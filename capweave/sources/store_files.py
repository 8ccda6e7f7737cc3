"""The capture store on disk: an index of metadata and a table of bodies.

The index is sorted by key, so a lookup of few keys reads few row groups, and
listing captures never touches a body.  Bodies are kept once per content
address.  Appending writes new files only; nothing stored is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capweave.operators.scratch import materialize
from capweave.operators.store import METADATA_COLUMNS, append_new, distinct_bodies, latest

_INDEX, _BODIES = "index", "bodies"


def _write(captures: DataFrame, bodies: DataFrame, root: str, mode: str) -> None:
    index = captures.select(*METADATA_COLUMNS, "body_digest")
    # Bodies first: an index row never points at a body that is not there yet.
    bodies.write.mode(mode).parquet(f"{root}/{_BODIES}")
    index.repartitionByRange("surt", "capture_id").sortWithinPartitions("surt").write.mode(mode).parquet(
        f"{root}/{_INDEX}"
    )


def write_store(captures: DataFrame, root: str) -> None:
    """Start the store anew with the current capture of each key."""
    # Written down: bodies and index both read it, and each reading would look for the winners anew.
    current = materialize(latest(captures), "current")
    _write(current, distinct_bodies(current), root, "overwrite")


def append_store(captures: DataFrame, root: str) -> None:
    """Add captures of keys that are not stored; stored ones are kept."""
    spark = captures.sparkSession
    fresh = materialize(append_new(read_index(spark, root), captures), "fresh")
    known = read_bodies(spark, root).select("body_digest")
    _write(fresh, distinct_bodies(fresh).join(known, "body_digest", "left_anti"), root, "append")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_INDEX}")


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_BODIES}")
