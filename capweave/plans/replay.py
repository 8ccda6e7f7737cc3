"""A crawl replayed over a table of captures, from seeds to the stored result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capweave.operators import crawl, store
from capweave.operators.extract import Extractors, extract_links, resolve_links
from capweave.operators.scratch import materialize
from capweave.operators.skew import skew_join
from capweave.sources.config import CrawlConfig


@dataclass(frozen=True)
class Replay:
    """What a crawl leaves behind.

    ``info`` configuration and entry points; ``archived`` the current capture of
    every reached key with its hops and where it was found; ``missing`` reached
    keys nothing was captured for; ``failed`` captures over the size limit.
    """

    info: DataFrame
    archived: DataFrame
    missing: DataFrame
    failed: DataFrame


def replay(
    captures: DataFrame,
    raw_seeds: DataFrame,
    config: CrawlConfig,
    extractors: Extractors | None = None,
    stored: DataFrame | None = None,
) -> Replay:
    """Crawl ``captures`` as if they were the web.

    ``stored`` is an earlier store that must not be overwritten: its captures
    stand for their keys, seeds excepted, and are not expanded again.
    """
    seeds = store.seed_urls(raw_seeds)
    kept, failed = store.split_by_size(captures, config.max_body_length)
    web = store.latest(kept)
    known = None if stored is None else store.invalidate(stored, seeds)
    links = resolve_links(extract_links(web, config.rules, extractors))
    edges = materialize(crawl.crawl_edges(links), "links")
    reached = crawl.reach(edges, seeds, config.max_hops, stored=known)
    # A stored capture was not opened, so nothing was found in it.
    opened = edges
    if known is not None:
        closed = known.select(F.col("surt").alias("src_surt")).distinct()
        opened = skew_join(edges, closed, "src_surt", "surt", "left_anti")
    tree = crawl.discovery_tree(opened, reached, seeds).select(
        "surt", "hops", "discovered_in", F.col("url").alias("found_url")
    )
    held = store.scan_metadata(web).select("surt", "capture_id")
    if known is not None:
        # A stored capture wins over one of this crawl.
        held = held.join(known.select("surt"), "surt", "left_anti").unionByName(known.select("surt", "capture_id"))
    # Both sides have one row per key.
    return Replay(
        info=store.crawl_info(seeds, config.as_json),
        archived=tree.join(held, "surt"),
        missing=tree.join(held, "surt", "left_anti"),
        failed=failed.join(reached.select("surt"), "surt", "left_semi"),
    )
