"""Crawl replay: expand a frontier over known links until nothing new is found.

Distances are pairs (hops, steps), compared in that order and packed into one
long so that they aggregate in a hash table.  Steps count links followed; they
make the discovery parents a tree even where links cost no hop.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from capweave.functions.urls import host_of
from capweave.operators.scratch import materialize
from capweave.operators.skew import HEAVY_ROWS, copy_rows, heavy_keys, skew_join, spread_rows

_HOP = 1 << 32
_MERGE_EVERY = 8  # written rounds between merges of the seen table
_SMALL_FRONTIER = 20_000  # rows up to which several rounds go into one job
_STRIDES = 8


class RoundLimit(RuntimeError):
    """The replay did not settle within the allowed rounds."""


def crawl_edges(resolved: DataFrame) -> DataFrame:
    """Edges (src_surt, src_url, surt, url, cost) of resolved links."""
    return resolved.select(
        "src_surt", "src_url", "surt", "url", F.col("cross_host").cast("int").alias("cost")
    )


def _written(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write a table and learn its row count from the same job."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count("*").alias("n")), label)
    return table, seen.get["n"]


def reach(
    edges: DataFrame,
    seeds: DataFrame,
    max_hops: int,
    stored: DataFrame | None = None,
    max_rounds: int = 10_000,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Least (hops, steps) of every key within ``max_hops`` of the seeds.

    ``stored`` keys other than seeds count as found but are not expanded, which
    is how a resumed crawl treats them.  Each round joins only the keys that
    improved in the round before.  Runs at most ``max_rounds`` rounds and raises
    rather than return part of the answer.

    Most links lead to keys without links of their own, which lead nowhere.  So
    the rounds follow only links between keys that have some, each pair once,
    and one pass over all links afterwards gives the other keys their distance.
    """
    slim = edges.select(
        "src_surt", "surt", (F.col("cost").cast("long") * _HOP + 1).alias("step")
    )
    start = seeds.select("surt").distinct()
    # The extraction behind the edges runs once; the rounds read this table.
    slim = materialize(slim, "edges")
    heavy = heavy_keys(slim, "src_surt", heavy_rows)
    if stored is not None:
        closed = stored.select("surt").distinct().join(start, "surt", "left_anti")
        closed = closed.withColumnRenamed("surt", "src_surt")
        slim = materialize(skew_join(slim, closed, "src_surt", "surt", "left_anti", heavy_rows), "edges")
    onward = slim.select(F.col("src_surt").alias("surt")).distinct()
    inner = skew_join(slim, onward, "surt", "src_surt", "left_semi", heavy_rows)
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["src_surt", "salt"] if heavy is not None else ["src_surt"]
    # Laid out once by the join key; every round then moves the frontier only.
    table = (
        spread_rows(inner, "src_surt", heavy, "surt", "salt")
        .select(*keys, "surt", "step")
        .repartition(parts, *keys)
        .groupBy(*keys, "surt")
        .agg(F.min("step").alias("step"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    limit = (max_hops + 1) * _HOP

    def sources(state: DataFrame) -> DataFrame:
        moved = state.select(F.col("surt").alias("src_surt"), "dist")
        return moved if heavy is None else copy_rows(moved, "src_surt", heavy, "salt")

    def step(state: DataFrame) -> DataFrame:
        """Keys one link away."""
        onward = table.join(sources(state), keys).select(
            "surt", (F.col("dist") + F.col("step")).alias("dist")
        )
        return _nearest(onward.filter(F.col("dist") < limit))

    def stride(state: DataFrame) -> DataFrame:
        """The state together with the keys one link away, as one join, so that
        strides can be chained into one job."""
        both = sources(state).hint("shuffle_hash").join(table, keys, "left").select(
            F.explode(
                F.array(
                    F.struct(F.col("src_surt").alias("surt"), F.col("dist").alias("dist")),
                    F.struct(F.col("surt"), (F.col("dist") + F.col("step")).alias("dist")),
                )
            ).alias("_to")
        ).select("_to.*")
        return _nearest(both.filter(F.col("surt").isNotNull() & (F.col("dist") < limit)))

    try:
        frontier, count = _written(start.withColumn("dist", F.lit(0).cast("long")), "reach")
        merged, recent = frontier, []
        rounds = 0
        while count:
            if rounds >= max_rounds:
                raise RoundLimit(f"not settled after {max_rounds} rounds")
            if count > _SMALL_FRONTIER:
                rounds, found = rounds + 1, step(frontier)
            else:
                # A long tail of small rounds would be all job overhead.
                rounds, found = rounds + _STRIDES, frontier
                for _ in range(_STRIDES):
                    found = stride(found)
            known = _union([merged, *recent]).select(
                F.col("surt").alias("_surt"), F.col("dist").alias("_dist")
            )
            nearer = (F.col("surt") == F.col("_surt")) & (F.col("_dist") <= F.col("dist"))
            frontier, count = _written(found.join(known, nearer, "left_anti"), "reach")
            recent.append(frontier)
            if len(recent) == _MERGE_EVERY:
                merged, recent = materialize(_least([merged, *recent]), "reach"), []
        nearest = materialize(_least([merged, *recent]), "reach")
        last = spread_rows(slim, "src_surt", heavy, "surt", "salt").join(sources(nearest), keys).select(
            "surt", (F.col("dist") + F.col("step")).alias("dist")
        )
        last = last.filter(F.col("surt").isNotNull() & (F.col("dist") < limit))
        best = materialize(_least([nearest, last]), "reach")
    finally:
        table.unpersist()
    return best.select(
        "surt",
        F.expr("cast(dist div 4294967296 as int)").alias("hops"),
        F.expr("cast(dist % 4294967296 as int)").alias("steps"),
        "dist",
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    union = tables[0]
    for more in tables[1:]:
        union = union.unionByName(more)
    return union


def _nearest(found: DataFrame) -> DataFrame:
    return found.groupBy("surt").agg(F.min("dist").alias("dist"))


def _least(tables: list[DataFrame]) -> DataFrame:
    return _nearest(_union(tables))


def discovery_tree(edges: DataFrame, reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each reached key, where it was first found.

    Among the links that realise the least distance the least source URL wins.
    Every parent is one step nearer to a seed, so the chain ends at one.
    """
    source = reached.select(F.col("surt").alias("src_surt"), F.col("dist").alias("_src_dist"))
    target = reached.select("surt", "dist", "hops", "steps")
    links = edges.select(
        "src_surt", "src_url", "surt", "url", (F.col("cost").cast("long") * _HOP + 1).alias("step")
    )
    # Reduce to one candidate per (target, distance) before meeting the targets.
    best = F.min(F.struct("src_url", "src_surt", "url")).alias("_best")
    heavy = heavy_keys(links, "src_surt")
    candidates = (
        spread_rows(links, "src_surt", heavy, "surt")
        .join(copy_rows(source, "src_surt", heavy), ["src_surt", "_salt"])
        .groupBy("surt", (F.col("_src_dist") + F.col("step")).alias("dist"))
        .agg(best)
    )
    found = candidates.join(target, ["surt", "dist"]).filter(F.col("steps") > 0).select(
        "surt",
        F.col("_best.url").alias("url"),
        F.col("_best.src_url").alias("discovered_in"),
        F.col("_best.src_surt").alias("parent_surt"),
        "hops",
        "steps",
    )
    own = seeds.groupBy("surt").agg(F.min("url").alias("url"))
    roots = target.filter(F.col("steps") == 0).join(own, "surt").select(
        "surt",
        "url",
        F.col("url").alias("discovered_in"),
        F.col("surt").alias("parent_surt"),
        "hops",
        "steps",
    )
    return roots.unionByName(found)


def host_edges(edges: DataFrame) -> DataFrame:
    """Links between hosts."""
    return edges.groupBy(host_of(F.col("src_url")).alias("src_host"), host_of(F.col("url")).alias("dst_host")).agg(
        F.count("*").alias("links")
    )
