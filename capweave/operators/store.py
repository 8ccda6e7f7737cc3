"""The capture store: one current capture per key, bodies by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capweave.functions.urls import normalize_url, surt
from capweave.operators.ordering import ordered, with_rank
from capweave.operators.scratch import materialize
from capweave.operators.skew import HEAVY_ROWS, key_join, pick, skew_join

METADATA_COLUMNS = (
    "capture_id",
    "surt",
    "url",
    "discovered_in",
    "hops",
    "fetched_at",
    "status",
    "http_version",
    "headers",
    "remote_addr",
)


def scan_metadata(captures: DataFrame) -> DataFrame:
    """Captures without bodies; a Parquet scan then leaves the body column unread."""
    return captures.select(*METADATA_COLUMNS)


def latest_keys(captures: DataFrame) -> DataFrame:
    """The current capture of each key as (surt, fetched_at, capture_id).

    Aggregated before the shuffle, so a key with very many captures costs one
    row per map task.
    """
    newest = F.max(F.struct("fetched_at", "capture_id")).alias("_newest")
    return captures.groupBy("surt").agg(newest).select("surt", "_newest.*")


def latest(captures: DataFrame) -> DataFrame:
    """Keep the newest capture of each key, bodies included.

    Winners are found from three narrow columns; the wide rows are then joined
    on the capture id, which is unique, so no key is hot.  Rows that are no winners
    are left out before the shuffle.
    """
    return pick(captures, latest_keys(captures).select("capture_id"), "capture_id")


def versions(captures: DataFrame, keep: int | None = None) -> DataFrame:
    """Number the captures of each key from 1, oldest first.

    Built on the global order rather than a window per key, so a key with a
    third of all captures is spread over many tasks.
    """
    narrow = captures.select("surt", "fetched_at", "capture_id")
    ranked = with_rank(ordered(narrow, ["surt", "fetched_at", "capture_id"]))
    first = ranked.groupBy("surt").agg(F.min("rank").alias("_first"))
    numbered = skew_join(ranked, first, "surt", "capture_id", "inner").select(
        "surt",
        "fetched_at",
        "capture_id",
        (F.col("rank") - F.col("_first") + 1).alias("version"),
    )
    return numbered if keep is None else numbered.filter(F.col("version") <= keep)


def append_new(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append when stored keys must not be overwritten.

    The incoming side is cut to one capture per key first, so the anti join has
    unique keys on its large side.
    """
    fresh = latest_keys(incoming).join(store.select("surt"), "surt", "left_anti")
    return pick(incoming, fresh.select("capture_id"), "capture_id")


def seed_urls(raw: DataFrame, column: str = "raw_url") -> DataFrame:
    """Seeds from raw text: unparsable ones go, the rest start at zero hops."""
    return (
        raw.withColumn("url", normalize_url(F.col(column)))
        .filter(F.col("url").isNotNull())
        .select(
            surt(F.col("url")).alias("surt"),
            "url",
            F.col("url").alias("discovered_in"),
            F.lit(0).alias("hops"),
        )
    )


def invalidate(captures: DataFrame, seeds: DataFrame) -> DataFrame:
    """Captures whose key is not a seed; seeds are always fetched anew."""
    return key_join(captures, seeds, "surt", "capture_id", "left_anti")


def crawl_info(seeds: DataFrame, config_json: str) -> DataFrame:
    """Configuration and entry points of a crawl.

    The entry points stay a column of keys, one row each, because a seed list
    is data and may be long.
    """
    return seeds.select(F.lit(config_json).alias("config"), F.col("surt").alias("entry_point")).distinct()


def lookup(
    requests: DataFrame, captures: DataFrame, column: str = "request_url", heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Capture of each requested URL, nulls where none is stored.

    ``captures`` holds one row per key.
    """
    keyed = requests.withColumn("surt", surt(normalize_url(F.col(column))))
    return skew_join(keyed, captures, "surt", "request_id", "left", heavy_rows)


def distinct_bodies(captures: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """One row per content address.  Which capture donates the body is fixed by
    the least id, so bodies themselves are not compared or aggregated.

    ``digests`` may give capture_id and body_digest of the same captures where they are written down already.
    """
    donors = (captures if digests is None else digests).groupBy("body_digest").agg(F.min("capture_id").alias("capture_id"))
    donors = materialize(donors, "donors")
    bodies = pick(captures.select("capture_id", "body"), donors, "capture_id")
    return bodies.join(donors, "capture_id").select("body_digest", "body")


def attach_bodies(
    captures: DataFrame, bodies: DataFrame, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Body of each capture by content address, null where the body is gone.

    Empty and error bodies are shared by very many captures; those addresses
    are salted.
    """
    return skew_join(captures, bodies, "body_digest", "capture_id", "left", heavy_rows)


def duplicate_bodies(captures: DataFrame) -> DataFrame:
    """Addresses with more than one capture."""
    return (
        captures.groupBy("body_digest", "surt")
        .agg(F.count("*").alias("n"))
        .groupBy("body_digest")
        .agg(F.sum("n").alias("captures"), F.count("*").alias("keys"), F.min("surt").alias("first_surt"))
        .filter(F.col("captures") > 1)
    )


def split_by_size(captures: DataFrame, max_body_length: int | None) -> tuple[DataFrame, DataFrame]:
    """(stored, failed): a body longer than the limit fails the capture."""
    if max_body_length is None:
        too_large = F.lit(False)
    else:
        too_large = F.octet_length("body") > max_body_length
    failed = captures.filter(too_large).withColumn("error", F.lit("BodyTooLarge")).drop("body")
    return captures.filter(~too_large), failed


def unseen(frontier: DataFrame, store: DataFrame) -> DataFrame:
    """Frontier rows, one per key, whose key is not stored yet."""
    best = F.min(F.struct("hops", "discovered_in", "url")).alias("_best")
    unique = frontier.groupBy("surt").agg(best).select("surt", "_best.*")
    return unique.join(store.select("surt"), "surt", "left_anti")
