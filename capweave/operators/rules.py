"""Routing of captures to extractors by URL pattern and media type."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.functions.http import mime, mime_matches


@dataclass(frozen=True)
class Rule:
    """An extractor and the captures it is for.

    ``url_pattern`` is searched anywhere in the URL; None passes every URL.  A
    capture without a readable Content-Type passes any ``mime_types``.
    """

    name: str
    extractor: str
    url_pattern: str | None = None
    mime_types: tuple[str, ...] = ()


def rule_matches(rule: Rule, url: Column, media_type: Column) -> Column:
    by_type = mime_matches(media_type, rule.mime_types)
    return by_type if rule.url_pattern is None else url.rlike(rule.url_pattern) & by_type


def filter_by_rule(captures: DataFrame, rule: Rule) -> DataFrame:
    return captures.filter(rule_matches(rule, F.col("url"), mime(F.col("headers"))))


def dispatch(captures: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per capture and matching rule, in a column ``rule``.

    Rules are configuration, known when the plan is built.  They become one
    array expression over each capture, so there is no join at all.
    """
    media_type = F.col("_mime")
    names = F.array(
        *[F.when(rule_matches(r, F.col("url"), media_type), F.lit(r.name)) for r in rules]
    )
    return (
        captures.withColumn("_mime", mime(F.col("headers")))
        .withColumn("rule", F.explode(F.array_compact(names)))
        .drop("_mime")
    )
