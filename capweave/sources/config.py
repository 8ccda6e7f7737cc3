"""Crawl configuration from a TOML file."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass

from capweave.operators.rules import Rule

# Quota used where the file states none.
DEFAULT_QUOTA = (200, "second")


@dataclass(frozen=True)
class CrawlConfig:
    """The settings that affect data: hop and size limits, quota, rules."""

    max_hops: int
    max_body_length: int | None
    quota: tuple[int, str]
    rules: tuple[Rule, ...]
    text: str

    @property
    def as_json(self) -> str:
        return json.dumps(tomllib.loads(self.text))


def parse_config(text: str, extractors: Mapping[str, str] | None = None) -> CrawlConfig:
    """Rules come in the order of their names.

    A script names its extractor with ``extractor``.  Files without that entry
    are read through ``extractors``, which maps script names to extractors; a
    script in neither is taken to be named like its extractor.
    """
    extractors = extractors or {}
    data = tomllib.loads(text)
    limiter = data.get("ratelimiter", {})
    rules = []
    for name, script in sorted(data.get("scripts", {}).items()):
        wanted = script.get("filter", {})
        rules.append(
            Rule(
                name=name,
                extractor=script.get("extractor") or extractors.get(name, name),
                url_pattern=wanted.get("url_pattern"),
                mime_types=tuple(wanted.get("mime_types", ())),
            )
        )
    return CrawlConfig(
        max_hops=data["general"]["max_hops"],
        max_body_length=data.get("http", {}).get("max_body_length"),
        quota=(limiter.get("n", DEFAULT_QUOTA[0]), limiter.get("per", DEFAULT_QUOTA[1])),
        rules=tuple(rules),
        text=text,
    )


def read_config(path: str, extractors: Mapping[str, str] | None = None) -> CrawlConfig:
    with open(path, encoding="utf-8") as source:
        return parse_config(source.read(), extractors)
