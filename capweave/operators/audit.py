"""Accounting over captures: counts, fetch rates, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.functions.http import mime
from capweave.functions.urls import host_of

# The periods a request quota may be stated for.
PERIODS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour"}


def capture_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy(
        host_of(F.col("url")).alias("host"),
        "status",
        F.coalesce(mime(F.col("headers")), F.lit("")).alias("mime"),
    ).agg(F.count("*").alias("captures"))


def error_counts(failed: DataFrame) -> DataFrame:
    """Failed captures by error and host."""
    return failed.groupBy("error", host_of(F.col("url")).alias("host")).agg(F.count("*").alias("failures"))


def fetch_rate(captures: DataFrame, per: str, limit: int, time: Column | None = None) -> DataFrame:
    """Captures per period against a quota of ``limit`` per period.

    A full burst plus what is replenished during the period can let through
    twice the quota, so a window over the quota is marked apart from one that
    no lawful schedule explains.  Works on batch and streaming input.
    """
    at = (F.col("fetched_at") if time is None else time).cast("timestamp")
    return (
        captures.withColumn("_at", at)
        .groupBy(F.window("_at", PERIODS[per]).alias("_window"))
        .agg(F.count("*").alias("captures"))
        .select(
            F.date_format("_window.start", "yyyy-MM-dd HH:mm:ss").alias("period_start"),
            "captures",
            (F.col("captures") > limit).alias("over_quota"),
            (F.col("captures") > 2 * limit).alias("over_burst"),
        )
    )
